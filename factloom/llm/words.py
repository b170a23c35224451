"""Numpy kernels over the UTF-8 bytes of a batch of texts: offsets, word bounds, hashes.

A word is a maximal run of characters other than space and U+0009 to U+000D. Those six are ASCII, so words
can be found in the bytes. Null texts have no bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True

#: Base of the polynomial hash (odd), its inverse modulo 2**64, and two odd multipliers that mix bits.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and doubled as needed."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        new = np.full(max(n, 1 << 16, 0 if have is None else 2 * len(have)), base, np.uint64)
        new[0] = 1
        have = _powers[int(base)] = np.cumprod(new)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    return x ^ (x >> np.uint64(31))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (uint8) and the offset of each row, one more than rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) else "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(col.buffers()[1], kind, n + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each row (one more than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = ~BLANK[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = ink[edges]
    last[edges - 1] = ink[edges - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def prefix(data: np.ndarray) -> np.ndarray:
    """h[i]: the sum over j < i of (byte j + 1) * BASE**j."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=h[1:])
    return h


def span_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes lo..hi that doesn't depend on where they stand."""
    inverse = powers(INVERSE, len(h))
    return mix((h[hi] - h[lo]) * inverse[lo] + (hi - lo).astype(np.uint64) * MIX2)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the number of words before each row."""
    start, end, before = bounds(data, at)
    return span_hash(prefix(data), start, end), before
