"""Words ``[^\\x20\\x09-\\x0D]+`` as SQL expressions and as hashed numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six separators, and the patterns made of them.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a word ends where its document does."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = solid[edges]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    before = edges[edges > 0] - 1
    last[before] = solid[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashed_words(data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts, ends (bytes), and the n + 1 offsets of each document's words.

    A word's hash is a Rabin-Karp polynomial modulo 2**64 over random byte values, mixed
    with its length. Bytes are worked on in pieces, so temporaries stay small.
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64)
    starts, ends = _bounds(data, offsets)
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + piece, side="right")))
        n = int(ends[to - 1] - base)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[base : base + n]] * powers(_BASE, n), out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        hashes[at:to] = mix((sums[e] - sums[s]) * powers(_INVERSE, n)[s] + (e - s).astype(np.uint64))
        at = to
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def second_hashes(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same words; windows of them collide independently."""
    return mix(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rolling Rabin-Karp hashes of ``width`` consecutive values, one for each start."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        sums = sums * _BASE + hashes[k : k + n]
    return mix(sums)


def window_starts(words: np.ndarray, width: int) -> np.ndarray:
    """Word numbers that begin a window inside one document; ``words`` are the n + 1 offsets."""
    counts = np.diff(words)
    n = int(words[-1])
    left = np.repeat(words[1:], counts) - np.arange(n)
    return np.flatnonzero(left >= width)
