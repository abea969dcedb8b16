"""A keyed one-to-one map of row numbers: a shuffle that every task can compute for its own rows."""

from __future__ import annotations

from hashlib import md5

import numpy as np

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """64-bit hash of every number under a key."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(numbers: np.ndarray, n: int, key: str) -> np.ndarray:
    """Images of numbers below ``n``: a balanced Feistel network over the next power of four, walked until it is below ``n`` again."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [int(md5(f"{key}:{r}".encode()).hexdigest()[:16], 16) for r in range(ROUNDS)]
    out = numbers.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):  # less than four walks on average
        left, right = out[open_] >> half, out[open_] & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right, k) & mask)
        out[open_] = (left << half) | right
        open_ = open_[out[open_] >= np.uint64(n)]
    return out.astype(np.int64)
