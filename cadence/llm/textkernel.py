"""Word and n-gram hashes of whole Arrow string columns, computed on their UTF-8 buffers with NumPy.

A word is a maximal run of ASCII letters, digits and non-ASCII bytes; texts are lower-cased by Spark before they come
here. No Python object is made for a word: a slice of some hundred kilobytes of text, whose arrays fit the caches, is hashed in some twenty array passes.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words(NamedTuple):
    """Words of some rows: hash, first byte, end byte; row r has the words bounds[r]:bounds[r + 1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) in runs of rows of about size bytes; one row is never cut."""
    data, at = buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Keeps the tables of powers between slices."""

    def __init__(self) -> None:
        self.n = 0

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * SLICE_BYTES)
            self.up, self.down = _powers(_BASE, self.n), _powers(_INVERSE, self.n)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * self.up[: len(data)], out=total[1:])
        return total

    def spans(self, total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte span of the data that total, from sums(), belongs to."""
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        if not len(data):
            none = np.zeros(0, np.int64)
            return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), data, offsets)
        word = _WORD_BYTE[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        first[inner] |= word[inner]
        last[inner - 1] |= word[inner - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return Words(self.spans(self.sums(data), start, end), start, end, np.searchsorted(start, offsets), data, offsets)


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams and the bounds of each row's. A row of 1 to n - 1 words has one, of all its words."""
    h, bounds = words.hash, words.bounds
    size = np.diff(bounds)
    if n == 1:
        return h, bounds
    short = (size > 0) & (size < n)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    left = np.repeat(size, size) - (np.arange(len(h)) - np.repeat(bounds[:-1], size))  # words from here to the row's end
    for k in range(n):
        total = total * np.uint64(0x9FB21C651E98DF25) + np.where(left > k, padded[k : k + len(h)], np.uint64(k + 1))
    keep = left >= n
    keep[bounds[:-1][short]] = True
    return mix(total[keep]), np.concatenate([[0], np.cumsum(np.where(short, 1, np.maximum(0, size - n + 1)))])


def distinct_per_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their bounds."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.searchsorted(r[keep], np.arange(len(bounds)))


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column; bounds has one entry more than there are rows."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
