"""Arrays of numbers in binary columns, and a mixing hash for them."""

from __future__ import annotations

import numpy as np
import zstandard

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(32))


def pack(values: np.ndarray) -> bytes:
    """An array as zstd-packed byte planes, which suits small numbers."""
    a = np.ascontiguousarray(values)
    return a.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    dtype = np.dtype(bytes(data[:1]).decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def small(values: np.ndarray) -> np.ndarray:
    """Unsigned 32-bit integers where they do, else 64-bit ones."""
    return values.astype(np.uint32 if not values.size or values.max() < 1 << 32 else np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    z = values.astype(np.uint64) * _MIX[0]
    z = (z ^ (z >> _MIX[2])) * _MIX[1]
    return z ^ (z >> _MIX[2])
