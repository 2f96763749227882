"""Baseline TIFF images (one page, uncompressed strips) to and from NumPy arrays."""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format: tags, and the bytes of the field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, COUNTS, KIND = 256, 257, 258, 259, 273, 277, 278, 279, 339
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 16: 8}
_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}


def decode(content: bytes) -> np.ndarray:
    """The image; what is not a plain two-dimensional one is an error that says why."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", content[4:8])
    (n,) = struct.unpack_from(order + "H", content, at)
    fields: dict[int, tuple[int, ...]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", content, at + 2 + 12 * i)
        if kind in _SIZES:
            place = at + 10 + 12 * i
            if _SIZES[kind] * count > 4:
                (place,) = struct.unpack_from(order + "I", content, place)
            fields[tag] = struct.unpack_from(f"{order}{count}{_CODES[kind]}", content, place)
    if fields.get(COMPRESSION, (1,))[0] != 1:
        raise ValueError("compressed TIFF")
    if fields.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("the image has 3 dimensions, not 2")
    kind = {1: "u", 2: "i", 3: "f"}[fields.get(KIND, (1,))[0]]
    dtype = np.dtype(f"{order}{kind}{fields[BITS][0] // 8}")
    raw = b"".join(content[a : a + b] for a, b in zip(fields[STRIPS], fields[COUNTS]))
    return np.frombuffer(raw, dtype).reshape(fields[HEIGHT][0], fields[WIDTH][0]).astype(dtype.newbyteorder("="))


def encode(image: np.ndarray) -> bytes:
    """One strip, little-endian."""
    raw = image.astype(image.dtype.newbyteorder("<")).tobytes()
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    entries = [(WIDTH, image.shape[1]), (HEIGHT, image.shape[0]), (BITS, 8 * image.itemsize), (COMPRESSION, 1), (STRIPS, 8), (SAMPLES, 1), (ROWS, image.shape[0]), (COUNTS, len(raw)), (KIND, kind)]
    table = b"".join(struct.pack("<HHII", tag, 4, 1, value) for tag, value in entries)
    return b"II" + struct.pack("<HI", 42, 8 + len(raw)) + raw + struct.pack("<H", len(entries)) + table + bytes(4)
