"""Simple-8b: 64-bit words, each a 4-bit selector and 60 bits of equally wide values.

Selectors 1 to 14 pack ``COUNT[s]`` values of ``WIDTH[s]`` bits, lowest first.  Selector 0 is the
escape; see ``encode_block``, which any values of up to 64 bits survive.
"""

from __future__ import annotations

import numpy as np

COUNT = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTH = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)


def _pack(values: np.ndarray, step: np.ndarray, kind: np.ndarray) -> np.ndarray:
    at, starts, n, s = 0, [], len(values), step.tolist()
    while at < n:
        starts.append(at)
        at += s[at]
    starts = np.array(starts, dtype=np.int64)
    kinds = kind[starts]
    words = kinds.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])  # what the last word lacks is zero
    for k in range(1, 15):
        which = np.flatnonzero(kinds == k)
        if len(which):
            first, packed = starts[which], words[which]
            for lane in range(COUNT[k]):
                packed |= padded[first + lane] << np.uint64(lane * WIDTH[k])
            words[which] = packed
    return words


def encode(values: np.ndarray) -> np.ndarray:
    """Values under 2**60 as words; the last word may be padded with zeros."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    kind = _kinds(values)
    return _pack(values, np.array(COUNT)[kind], kind)


def _kinds(values: np.ndarray) -> np.ndarray:
    """For each place the densest selector whose word could start there; what lies past the end fits any.

    A selector fits where the rolling maximum of the values' own width classes does not exceed it;
    rolling maxima of bytes are built by doubling.
    """
    n = len(values)
    own = np.zeros(n + 64, np.uint8)
    own[:n] = _SMALL_CLASS[values] if values.max() < len(_SMALL_CLASS) else _class(values)
    rolling, power = own, 1
    kind = own[:n].copy()
    kind[:] = 14
    for k in range(14, 0, -1):
        while power * 2 <= COUNT[k]:
            rolling = np.maximum(rolling[:-power], rolling[power:])
            power *= 2
        shift = COUNT[k] - power
        kind[np.maximum(rolling[:n], rolling[shift : shift + n]) <= k] = k
    return kind


def _class(values: np.ndarray) -> np.ndarray:
    """The selector of the narrowest width that holds a value."""
    limits = np.array([1 << w for w in WIDTH[1:]], dtype=np.uint64)
    return (np.searchsorted(limits, values, side="right") + 1).astype(np.uint8)


_SMALL_CLASS = _class(np.arange(1 << 16, dtype=np.uint64))


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values that ``encode`` packed."""
    words = np.asarray(words, dtype=np.uint64)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNT)[kinds] if len(words) else np.zeros(0, int)
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    payload = words & np.uint64((1 << 60) - 1)
    for k in range(1, 15):
        which = np.flatnonzero(kinds == k)
        if len(which):
            first, packed, mask = (ends - counts)[which], payload[which], np.uint64((1 << WIDTH[k]) - 1)
            for lane in range(COUNT[k]):
                out[first + lane] = packed >> np.uint64(lane * WIDTH[k]) & mask
    return out[:n]


def encode_block(values: np.ndarray) -> np.ndarray:
    """Self-contained form: runs between escapes carry their lengths, so that any values come back.

    Without escapes it is the plain packed form after one word that holds the number of values.  An
    escape word (selector 0) holds two counts: raw values that follow it (low 30 bits) and packed
    values after those (high 30 bits).
    """
    values = np.ascontiguousarray(values, dtype=np.uint64)
    wide = np.flatnonzero(values >> np.uint64(60))
    out, at = [], 0
    runs = np.split(wide, np.flatnonzero(np.diff(wide) > 1) + 1) if len(wide) else []
    bounds = [(int(r[0]), int(r[-1]) + 1) for r in runs] + [(len(values), len(values))]
    raw = values[:0]
    for a, b in bounds:
        packed = values[at:a]
        out += [np.array([len(raw) | len(packed) << 30], np.uint64), raw, encode(packed)]
        raw, at = values[a:b], b
    if len(raw):
        out += [np.array([len(raw)], np.uint64), raw]
    return np.concatenate(out)


def decode_block(words: np.ndarray) -> np.ndarray:
    out, at = [], 0
    while at < len(words):
        head = int(words[at])
        raw, packed = head & (1 << 30) - 1, head >> 30
        out.append(words[at + 1 : at + 1 + raw])
        at += 1 + raw
        if packed:
            kinds = (words[at:] >> np.uint64(60)).astype(np.int64)
            ends = np.cumsum(np.array((*COUNT, 1))[kinds])  # what lies past the run is raw
            used = int(np.searchsorted(ends, packed)) + 1
            out.append(decode(words[at : at + used], packed))
            at += used
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
