"""Texts of an Arrow batch as one array of bytes: words, hashes of spans, windows of words.

Everything is vectorised over a slice of rows, and hashing goes in blocks, so memory is bounded by
the slice and by the longest single text. Hashes have 64 bits: polynomial over the bytes, modulo
2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

SLICE = 2_000_000
_BLOCK = 2_000_000
_BASE = 0x9E3779B97F4A7C15

#: Bytes between words: space, and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte that is neither letter nor digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_SAME = np.arange(256, dtype=np.uint8)
LOWER = _SAME.copy()
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit integers (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A fixed permutation of the bytes, for a second hash that is independent of the first.
SCRAMBLED = np.argsort(mix(np.arange(256, dtype=np.uint64))).astype(np.uint8)


@cache
def _byte_values(lower: bool) -> np.ndarray:
    return mix(((LOWER if lower else _SAME).astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))


@cache
def _powers(n: int, inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, from a table whose size is a power of two."""
    return _powers(1 << max(n - 1, 1).bit_length(), inverse)[:n]


def sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running polynomial sums of the bytes, starting with 0; see `between`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(lower)[data] * powers(len(data)), out=out[1:])
    return out


def between(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) by the running sums of their bytes."""
    h = (total[end] - total[start]) * powers(len(total), True)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolling(total: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all spans of one size, by the running sums of the bytes; as of `between`."""
    n = max(len(total) - size, 0)
    h = (total[size:] - total[:n]) * powers(max(n, 1), True)[:n]
    return mix(h + np.uint64(size) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False
) -> np.ndarray:
    """Hashes of the spans [start, end), which are in order and don't overlap, block by block."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        at = start[i]
        j = max(i + 1, int(np.searchsorted(end, at + _BLOCK, "right")))
        total = sums(data[at : end[j - 1]], lower)
        out[i:j] = between(total, start[i:j] - at, end[i:j] - at)
        i = j
    return out


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(ends):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most `size` bytes of text, or one row."""
    _, offsets = strings(batch.column(column))
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


@dataclass
class Words:
    """Words of a slice: their spans in `data`, the row of each, and `first`: where each row's words
    begin.
    """

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, lower)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(column: pa.Array, between_words: np.ndarray = SPACES) -> Words:
    """The runs of bytes that aren't between words; no word crosses rows."""
    data, offsets = strings(column)
    inside = ~between_words[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = ~inside[:-1]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = ~inside[1:]
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, row, first)


def windows(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words within a row, and the places of their first words."""
    n = max(0, len(hashes) - size + 1)
    at = np.flatnonzero(row[:n] == row[size - 1 :][:n])
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = mix(out + hashes[at + k] + np.uint64(k + 1))
    return out, at


def distinct(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, key), in order."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of `size` lower-cased words of each row, in order of row and hash.

    A row with fewer words has its whole sequence as the only one; a row without words has none.
    """
    h = w.hashes(lower=True)
    key, at = windows(h, w.row, size)
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    whole = np.array(
        [
            mix(np.array([hash_of(h[w.first[r] : w.first[r + 1]])], np.uint64))[0] for r in short
        ],
        np.uint64,
    )
    return distinct(np.concatenate([w.row[at], short]), np.concatenate([key, whole]))


def hash_of(values: np.ndarray) -> np.uint64:
    """One hash of a sequence of 64-bit integers, by its order and length."""
    total = (mix(values + np.uint64(_BASE)) * powers(len(values) + 1)[1:]).sum(dtype=np.uint64)
    return mix(np.array([total + np.uint64(len(values))], np.uint64))[0]


def signed(keys: np.ndarray) -> pa.Array:
    """As Spark's bigint."""
    return pa.array(np.ascontiguousarray(keys).view(np.int64))
