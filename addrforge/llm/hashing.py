"""Vectorised hashing of substrings, words and word shingles of whole batches of UTF-8 texts.

A polynomial prefix sum modulo 2**64 gives the hash of any byte range in constant time; words are
maximal runs of 0-9, a-z (after lower-casing A-Z) and non-ASCII bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n (kept between calls)."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, _INVERSE)):
            grown = np.full(n, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.cumprod(grown)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the array and the n + 1 offsets of its texts."""
    wide = pa.types.is_large_string(text.type)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    if text.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of (byte + 1) * BASE**k for i <= k < j."""
    out = np.zeros(len(data) + 1, np.uint64)
    up, _ = powers(len(data) + 1)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 offsets of each text's words."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = WORD[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]  # a word never crosses texts
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):
        begins[cuts] = inside[1:-1][cuts]
        ends[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = prefix_sums(LOWER[data])
    _, down = powers(len(data) + 1)
    return mix((sums[end] - sums[start]) * down[start])


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words inside a text (of all its words, if fewer), and each text's offsets."""
    counts = np.diff(offsets)
    out_counts = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate(([0], np.cumsum(out_counts)))
    total = int(out_offsets[-1])
    if not total:
        return np.zeros(0, np.uint64), out_offsets
    doc = np.repeat(np.arange(len(counts)), out_counts)
    first = offsets[:-1][doc] + np.arange(total) - out_offsets[:-1][doc]
    span = np.minimum(n, counts)[doc]
    sums = np.zeros(total, np.uint64)
    for j in range(n):
        part = hashes[np.minimum(first + j, len(hashes) - 1)] * np.uint64(pow(BASE, j + 1, 1 << 64))
        sums += part if span.min() > j else np.where(span > j, part, np.uint64(0))
    return mix(sums), out_offsets
