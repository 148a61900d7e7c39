"""Vectorised work on the UTF-8 bytes of many texts at once.

A batch of texts is one byte buffer and its offsets. Word and line bounds are ASCII bytes,
so they are found in the bytes; a string's fingerprint is a difference of prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are worked on at a time; one text may be longer.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _symbols() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which fingerprint() takes any substring's value."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_symbols()[buf] * _power(BASE, len(buf)), out=out[1:])
    return out


def fingerprint(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of buf[start:end]; equal bytes have equal ones wherever they stand."""
    return mix((sums[end] - sums[start]) * _power(pow(BASE, -1, 1 << 64), len(sums))[start])


def fingerprints(sums: np.ndarray, length: int) -> np.ndarray:
    """Those of every string of the length, by where it begins."""
    out = sums[length:] - sums[:-length]
    out *= _power(pow(BASE, -1, 1 << 64), len(sums))[: len(out)]
    return mix(out)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A fingerprint of an ordered pair of fingerprints."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + (b ^ np.uint64(0xD6E8FEB86659FD93)))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts of about `limit` bytes."""
    return cuts(*utf8(column), limit)


def cuts(buf: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """slices() of bytes and offsets."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, buf[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(buf: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word: a run of bytes that aren't white space (or others outside words), within a text."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~outside[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def distinct(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, value) pairs, sorted by both."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]
