"""Hilbert curve places of points with integer coordinates, vectorised."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``points`` (unsigned, below 2**bits) on the Hilbert curve; bits * columns <= 63.

    Gray-code form: from the highest bit down, each coordinate whose bit is set flips the lower
    bits of the first one, else the differing lower bits are exchanged; then the transposed
    index is Gray-decoded and its bits are interleaved.
    """
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        high, low = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for i in range(n):
            set_ = (x[i] & high) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.uint64)
    for bit in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] & np.uint64(1 << bit)) != 0, flip ^ np.uint64((1 << bit) - 1), flip)
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key.astype(np.int64)
