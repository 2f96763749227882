"""Hashes of words and of runs of words, for many documents at a time."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from tessera.llm import caches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CACHED_WORDS = 100_000
_BASE = 0x9E3779B97F4A7C15
_known: dict[str, bytes] = {}
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def hashes(words: list[str]) -> bytes:
    """Eight bytes a word."""
    caches.hold(_known)
    try:
        return b"".join(map(_known.__getitem__, words))
    except KeyError:
        if len(_known) > CACHED_WORDS:
            _known.clear()
        _known.update((w, xxhash.xxh64_digest(w)) for w in set(words) if w not in _known)
        return b"".join(map(_known.__getitem__, words))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Runs:
    """Rolling hashes over words whose hashes are in ``own``; the k words from i on hash to ``of(k)[i]``."""

    def __init__(self, own: np.ndarray):
        self.n = len(own)
        up, self._down = _power(self.n + 1)
        self._sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(own * up[: self.n], out=self._sums[1:])

    def of(self, k: int) -> np.ndarray:
        if self.n < k:
            return np.zeros(0, np.uint64)
        out = (self._sums[k:] - self._sums[:-k]) * self._down[: self.n - k + 1]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return out


def rolling_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    if len(values) < width:
        return values[:0]
    power, out = 1, values
    while power * 2 <= width:
        out = np.minimum(out[:-power], out[power:])
        power *= 2
    rest = width - power
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
