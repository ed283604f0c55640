"""Vectorised byte, word and shingle hashing shared by the document operators.

Words are the maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.  A word's hash is a polynomial over random
per-byte constants, computed for all words of a block of texts at once from one running sum; shingle hashes mix the
hashes of consecutive words.  All arithmetic is modulo 2**64, so equal words have equal hashes in every process.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240611))
#: A random odd 64-bit constant for each byte.
BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Base of the polynomial and its inverse modulo 2**64.
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; grown and kept by the process."""
    have = len(_POWERS[0])
    if have < n:
        size = max(n, 2 * have)
        for k, b in enumerate((BASE, BASE_INV)):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply, three rounds)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U64(29))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the sum of BYTE[data[t]] * BASE**t over i <= t < j."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k bytes of data, by start."""
    if len(data) < k:
        return np.empty(0, np.uint64)
    s = prefix_sums(data)
    return mix((s[k:] - s[:-k]) * powers(len(data))[1][: len(data) - k + 1])


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of data (uint8)."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(SPACE[data], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.empty(0, np.uint64)
    s = prefix_sums(data)
    return mix((s[end] - s[start]) * powers(len(data))[1][start] + (end - start).astype(np.uint64))


def shingles(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive word hashes; of the whole sequence if it is shorter; empty without words."""
    n = min(n, len(w))
    if not n:
        return w[:0]
    m = len(w) - n + 1
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = mix(h * U64(0xFF51AFD7ED558CCD) + w[i : i + m])
    return h


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text (UTF-8; A-Z fold to a-z)."""
    data = np.frombuffer(text.lower(), np.uint8)
    return np.unique(shingles(word_hashes(data, *words(data)), n))
