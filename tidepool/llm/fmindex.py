"""FM-index of a shard's words in numpy: suffix order, wavelet-tree ranks, sampled suffix positions.

A shard is a sequence of symbols: the words of its documents, each document
closed by a separator. Separators differ from each other in the suffix order
and are one symbol in the transform; no search or walk passes one, because
the first place of every document is a sampled position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Every so many places a suffix position is kept.
SAMPLED = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order: a sort by the first few symbols, then prefix doubling of what is still tied. The last symbol must be unique."""
    n, width = len(symbols), max(1, int(symbols.max()).bit_length())
    depth = max(1, 62 // width)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key = (key << width) | padded[j : j + n]
    order = np.argsort(key)
    rank = np.full(n + 1, -1, np.int64)
    places = np.arange(n)
    key = key[order]
    while True:
        head = np.ones(len(places), bool)
        head[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(head)
        rank[order[places]] = np.repeat(places[heads], np.diff(np.append(heads, len(places))))
        alone = head.copy()
        alone[:-1] &= head[1:]
        places = places[~alone]
        if not len(places):
            return order
        tied = order[places]
        key = (rank[tied] << 32) | (rank[np.minimum(tied + depth, n)] + 1)
        by = np.argsort(key)
        key, order[places] = key[by], tied[by]
        depth *= 2


class Bits:
    """A bit vector with ranks."""

    def __init__(self, packed: np.ndarray):
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


@dataclass
class FMIndex:
    """vocabulary: sorted word hashes, symbol s is vocabulary[s - 1]; starts: where the suffixes of each symbol begin; levels: the wavelet tree, highest bit first."""

    n: int
    vocabulary: np.ndarray
    starts: np.ndarray
    levels: list[Bits]
    zeros: list[int]
    first: np.ndarray
    marks: Bits
    samples: np.ndarray

    def _down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.ones(i)
            i = np.where((symbols >> (len(self.levels) - 1 - level)) & 1, zeros + ones, i - ones)
        return i

    def step(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Rows before which the suffixes that start with the symbol and go on below row i end."""
        return self.starts[symbols] + self._down(symbols, i) - self.first[symbols]

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one place longer than that of row i."""
        symbols = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            bit, ones = bits.get(i), bits.ones(i)
            symbols = symbols * 2 + bit
            i = np.where(bit, zeros + ones, i - ones)
        return self.starts[symbols] + i - self.first[symbols]

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, by backward search. words: a row of hashes for each phrase, filled up at the end."""
        low, high = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        symbols = np.searchsorted(self.vocabulary, words)
        known = self.vocabulary[np.minimum(symbols, len(self.vocabulary) - 1)] == words if len(self.vocabulary) else np.zeros(words.shape, bool)
        symbols += 1
        open_ = np.flatnonzero((known | (np.arange(words.shape[1]) >= lengths[:, None])).all(axis=1))
        high[open_] = self.n
        for t in range(words.shape[1]):
            going = open_[lengths[open_] > t]
            if not len(going):
                break
            next_ = symbols[going, lengths[going] - 1 - t]
            low[going], high[going] = self.step(next_, low[going]), self.step(next_, high[going])
            open_ = open_[low[open_] < high[open_]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes of rows: walks back to the next sampled position."""
        out, steps = np.zeros(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            found = self.marks.get(rows)
            out[left[found]] = self.samples[self.marks.ones(rows[found])] + steps
            left, rows = left[~found], rows[~found]
            rows, steps = self.back(rows), steps + 1
        return out

    def dump(self) -> dict[str, bytes]:
        levels = b"".join(b.words.tobytes() for b in self.levels)
        return {"vocabulary": self.vocabulary.tobytes(), "starts": self.starts.astype(np.int32).tobytes(), "levels": levels, "marks": self.marks.words.tobytes(), "samples": self.samples.astype(np.int32).tobytes()}


def _whole(n: int, vocabulary: np.ndarray, starts: np.ndarray, levels: list[Bits], marks: Bits, samples: np.ndarray) -> FMIndex:
    index = FMIndex(n, vocabulary, starts, levels, [n - int(b.before[-1]) for b in levels], np.zeros(len(vocabulary) + 1, np.int64), marks, samples)
    symbols = np.arange(len(vocabulary) + 1)
    index.first = index._down(symbols, np.zeros(len(symbols), np.int64))
    return index


def build(hashes: np.ndarray, counts: np.ndarray) -> FMIndex:
    """Index of documents given as the hashes of their words one after another, and their numbers of words."""
    documents = len(counts)
    vocabulary, ids = np.unique(hashes, return_inverse=True)
    n = len(hashes) + documents
    places = np.arange(len(hashes)) + np.repeat(np.arange(documents), counts)
    ends = np.cumsum(counts + 1) - 1
    symbols = np.zeros(n, np.int64)
    symbols[places], symbols[ends] = ids + documents, np.arange(documents)
    order = suffix_order(symbols)
    symbols = np.maximum(symbols - documents + 1, 0)
    starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(vocabulary) + 1))])[:-1]
    row, levels = symbols[order - 1].astype(np.int32), []
    for level in range(max(1, len(vocabulary).bit_length()) - 1, -1, -1):
        bit = ((row >> level) & 1).astype(bool)
        levels.append(Bits(np.packbits(bit, bitorder="little")))
        row = np.concatenate([row[~bit], row[bit]])
    begins = np.zeros(n, bool)
    begins[::SAMPLED] = True
    begins[ends + 1 - (counts + 1)] = True
    kept = begins[order]
    return _whole(n, vocabulary, starts, levels, Bits(np.packbits(kept, bitorder="little")), order[kept])


def load(n: int, vocabulary: bytes, starts: bytes, levels: bytes, marks: bytes, samples: bytes) -> FMIndex:
    """The index that dump() wrote."""
    known, size = np.frombuffer(vocabulary, np.uint64), len(marks)
    tree = [Bits(np.frombuffer(levels, np.uint8, size, at)) for at in range(0, len(levels), size)]
    return _whole(n, known, np.frombuffer(starts, np.int32).astype(np.int64), tree, Bits(np.frombuffer(marks, np.uint8)), np.frombuffer(samples, np.int32).astype(np.int64))
