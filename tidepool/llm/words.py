"""Vectorised scans of UTF-8 text columns: words, their hashes, shingles.

All functions work on one slice of an Arrow string column at a time. A slice
holds whole documents and about SLICE_BYTES of text (one longer document is a
slice of its own), so memory follows the longest document, not the batch.
Hashes are polynomials modulo 2^64, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Slice:
    """Documents first .. last of a batch: their bytes, and where each starts and ends in them."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column (null: empty text) into slices."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if len(column) else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        low = offsets[first]
        yield Slice(first, last, data[low : offsets[last]], offsets[first:last] - low, offsets[first + 1 : last + 1] - low)
        first = last


@dataclass
class Words:
    """Words of a slice in order: byte spans, and the range of words of each document."""

    begin: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return self.high - self.low

    def owner(self) -> np.ndarray:
        """The document (within the slice) of each word."""
        return np.repeat(np.arange(len(self.low)), self.counts)


def words(part: Slice, members: np.ndarray = ~_SEPARATOR) -> Words:
    """Words are runs of bytes of `members`, without it of those other than space and 0x09-0x0D; none crosses documents."""
    inside = members[part.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[part.starts] = True
    edge[len(inside)] = True
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    begin = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return Words(begin, end, np.searchsorted(begin, part.starts), np.searchsorted(begin, part.ends))


class Hasher:
    """Hashes of any byte spans of a slice, in constant time each."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        forward, self.back = _power_tables(len(data) + 1)
        values = (_LOWER[data] if lower else data).astype(np.uint64)
        values += np.uint64(1)
        values *= forward[: len(data)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=self.sums[1:])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])


def shingles(hashes: np.ndarray, found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of k words; a text of fewer words is one run as a whole."""
    n, counts = len(hashes), found.counts
    powers = np.array([pow(int(_STEP), t, 1 << 64) for t in range(k)], np.uint64)
    rolled = np.zeros(n, np.uint64)
    for t in range(min(k, n)):
        rolled[: n - t] += hashes[t:] * powers[t]
    owner = found.owner()
    place = np.arange(n) - found.low[owner]
    short = counts[owner] < k
    keep = (place + k <= counts[owner]) & ~short
    docs, out = owner[keep], rolled[keep]
    if short.any():
        where = np.flatnonzero(short)
        heads = np.flatnonzero(np.r_[True, np.diff(owner[where]) != 0])
        docs = np.r_[docs, owner[where][heads]]
        out = np.r_[out, np.add.reduceat(hashes[where] * powers[place[where]], heads) + np.uint64(k)]
    return docs, mix(out)


def distinct(docs: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes in ascending order: (sorted hashes, bounds of length n + 1)."""
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    keep = np.ones(len(docs), bool)
    keep[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    docs, hashes = docs[keep], hashes[keep]
    return hashes, np.searchsorted(docs, np.arange(n + 1))
