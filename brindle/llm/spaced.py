"""Hashes of the words between white space, computed for a whole text by numpy.

A word (A-Z lower-cased, its bytes b_0 .. b_k) has the polynomial sum of (b_i + 1) B^i
modulo 2^64 for a fixed odd B, mixed. Prefix sums over the text give all words at
once: no Python object a word, and nothing kept between texts but the powers of B.

Two different words share a hash with a probability of about 2^-64 a pair; texts
built against B could force it, as against any fixed hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from brindle.llm.packed import mixed

_BASE = 0x9FB21C651E98DF25
_SPACES = b"\t\n\v\f\r "
#: Bytes of a text that are hashed at once, up to the next white space.
STRETCH = 1 << 18
_SPACE = re.compile(b"[" + re.escape(_SPACES) + b"]")


def _digits() -> np.ndarray:
    """What each byte counts for: 0 for white space, A-Z as a-z."""
    byte = np.arange(256)
    byte[65:91] += 32
    out = byte.astype(np.uint64) + np.uint64(1)
    out[list(_SPACES)] = 0
    return out


_DIGITS = _digits()
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """B^i and B^-i for i below n or more; the tables grow to the longest stretch met."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def _stretches(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > STRETCH:
        found = _SPACE.search(data, at + STRETCH)
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def word_hashes(data: bytes) -> np.ndarray:
    """The hash of each word of a text (UTF-8) in order."""
    out = []
    for piece in _stretches(data):
        digits = _DIGITS[np.frombuffer(piece, np.uint8)]
        forward, back = _powers(len(digits) + 1)
        word = np.zeros(len(digits) + 2, bool)
        word[1:-1] = digits > 0
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(digits) + 1, np.uint64)
        np.cumsum(digits * forward[: len(digits)], out=sums[1:])
        out.append((sums[ends] - sums[starts]) * back[starts])
    return mixed(out[0] if len(out) == 1 else np.concatenate(out))
