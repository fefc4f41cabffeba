"""Numpy kernels over the bytes of many texts at once: rolling hashes, words, word windows.

Hashes are 64-bit polynomials over a fixed random table of the 256 bytes, mixed at the end; equality of two hashes
stands for equality of the strings where the callers say so.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]
#: A permutation of the bytes: hashes of permuted bytes stand beside those of the bytes themselves.
OTHER = np.random.default_rng(77).permutation(256).astype(np.uint8)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grown(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    while len(have) < n:
        step = pow(BASE if which == "up" else INVERSE, len(have), 2**64)
        have = np.concatenate([have, have * np.uint64(step)])
        _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """n + 1 sums; `span_hash` takes the hash of any stretch from them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((BYTE_LOWER if lower else BYTE)[data] * _grown("up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _grown("down", len(prefix))[start] + (end - start).astype(np.uint64))


def rolling_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """Unmixed hash of each stretch of `size` bytes."""
    n = max(0, len(prefix) - size)
    return (prefix[size:] - prefix[:n]) * _grown("down", n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and the row of each; a word never crosses rows."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    starts_here = inside[1:-1] & ~inside[:-2]
    ends_here = inside[1:-1] & ~inside[2:]
    cut = offsets[:-1][np.diff(offsets) > 0]
    starts_here[cut] = inside[1:-1][cut]
    last = cut[cut > 0] - 1
    ends_here[last] = inside[1:-1][last]
    start = np.flatnonzero(starts_here)
    end = np.flatnonzero(ends_here) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of each word."""
    start, end, row = word_bounds(data, offsets)
    return span_hash(prefix_hash(data, lower), start, end), start, end, row


_STEP = np.uint64(0xD6E8FEB86659FD93)


def ngram_hashes(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and the indices of the words where n words of one row follow."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    acc = words[:m].copy()
    for k in range(1, n):
        acc *= _STEP
        acc += words[k : m + k]
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(acc[at]), at


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values` (one a byte) for each row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
