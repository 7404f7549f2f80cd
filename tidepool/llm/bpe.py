"""Byte-level BPE encoding and decoding: speculate, verify, merge only what fails.

Speculate: each word (as the tokenizer's own pattern cuts it) is covered
greedily by the longest tokens of the vocabulary, for all new words of a slice
at once. Verify: two neighbouring tokens are compatible if merging their
joined bytes gives back just these two; if every adjacent pair of a word is
compatible, no merge can cross a boundary, and the greedy cover is the BPE
result. The answers for pairs are kept in a sorted array and looked up for all
pairs of a slice at once. Words with a token that merging alone doesn't reach,
or with an incompatible pair, are merged exactly.

Vocabulary files are read on the driver and travel with the task, a fixed size
that doesn't grow with the data. They are never trained here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .workers import freed

#: Words (with their encodings) that a worker remembers; then it starts anew.
KEPT_WORDS = 400_000
#: Characters from which a single word is merged exactly without a greedy try.
LONG_WORD = 200


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabulary files: printable Latin-1 stays, the rest is moved past 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class ByteBpe:
    """One vocabulary: exact merging, greedy covers, pair checks, decoding."""

    def __init__(self, spec: str):
        import regex

        model = json.loads(spec)
        symbols = _byte_symbols()
        as_bytes = lambda token: bytes(symbols[c] for c in token)
        vocab = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.ids = {as_bytes(t): i for t, i in vocab.items() if t not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.ranks = {}
        for rank, (a, b) in enumerate(merges):
            a, b = as_bytes(a), as_bytes(b)
            self.ranks[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.text: list[bytes] = [b""] * size
        for t, i in self.ids.items():
            self.text[i] = t
        for t, i in self.special.items():
            self.text[i] = t.encode()
        self.longest = max(map(len, self.ids))
        self.by_length = [(n, self._table(n)) for n in range(self.longest, 0, -1)]
        self.by_length = [(n, t) for n, t in self.by_length if t is not None]
        self.single = np.array([self.ids[bytes([b])] for b in range(256)])
        self.lengths = np.array([len(t) for t in self.text])
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.decimal = [str(i) for i in range(size)]
        self.words: dict[str, bytes] = {}  # the ids of a word as int32: a third of a tuple's memory
        self.pair_keys, self.pair_good = np.zeros(0, np.int64), np.zeros(0, bool)
        self.whole: dict[int, bool] = {}

    def _table(self, n: int):
        """Tokens of n bytes as (sorted byte strings, their ids)."""
        found = sorted((t, i) for t, i in self.ids.items() if len(t) == n)
        if not found:
            return None
        keys = np.frombuffer(b"".join(t for t, _ in found), f"V{n}")
        order = np.argsort(self._hash(keys, n), kind="stable")
        return self._hash(keys, n)[order], keys[order], np.array([i for _, i in found])[order]

    @staticmethod
    def _hash(keys: np.ndarray, n: int) -> np.ndarray:
        """64-bit hashes of n-byte strings; hits are compared in full."""
        rows = keys.view(np.uint8).reshape(-1, n).astype(np.uint64)
        weights = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(n)], np.uint64)
        return (rows * weights).sum(axis=1, dtype=np.uint64)

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: again and again the adjacent pair of the lowest rank, leftmost first, is merged."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = new, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if r := self.ranks.get((new, ids[after[i]])):
                    heapq.heappush(heap, (r[0], i, r[1], new, ids[after[i]]))
            if before[i] >= 0 and (r := self.ranks.get((ids[before[i]], new))):
                heapq.heappush(heap, (r[0], before[i], r[1], ids[before[i]], new))
        return [t for t, on in zip(ids, alive) if on]

    def _cover(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match cover of all words at once: (word, token) in order."""
        at = begin.copy()
        active = np.arange(len(begin))
        words, tokens, steps, step = [], [], [], 0
        while len(active):
            left = end[active] - at[active]
            chosen = np.full(len(active), -1)
            for n, (hashes, keys, ids) in self.by_length:
                try_ = np.flatnonzero((chosen < 0) & (left >= n))
                if not len(try_):
                    continue
                rows = np.ascontiguousarray(data[at[active[try_]][:, None] + np.arange(n)])
                mine = self._hash(rows.reshape(-1).view(f"V{n}"), n)
                spot = np.minimum(np.searchsorted(hashes, mine), len(hashes) - 1)
                same = hashes[spot] == mine
                same[same] = keys[spot[same]] == rows.reshape(-1).view(f"V{n}")[same]
                chosen[try_[same]] = ids[spot[same]]
            words.append(active)
            tokens.append(chosen)
            steps.append(np.full(len(active), step))
            at[active] += self.lengths[chosen]
            active = active[at[active] < end[active]]
            step += 1
        words, tokens, steps = map(np.concatenate, (words, tokens, steps))
        order = np.lexsort((steps, words))
        return words[order], tokens[order]

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the joined bytes of each pair gives back the pair."""
        keys = left.astype(np.int64) << 32 | right
        known = np.searchsorted(self.pair_keys, keys)
        found = (known < len(self.pair_keys)) & (self.pair_keys[np.minimum(known, len(self.pair_keys) - 1)] == keys) if len(self.pair_keys) else np.zeros(len(keys), bool)
        new = np.unique(keys[~found])
        if len(new):
            if len(self.pair_keys) > 4 * KEPT_WORDS:
                self.pair_keys, self.pair_good = np.zeros(0, np.int64), np.zeros(0, bool)
                new = np.unique(keys)
            good = np.array([self.merge(self.text[k >> 32] + self.text[k & 0xFFFFFFFF]) == [k >> 32, k & 0xFFFFFFFF] for k in new.tolist()])
            keys_all = np.concatenate([self.pair_keys, new])
            order = np.argsort(keys_all)
            self.pair_keys, self.pair_good = keys_all[order], np.concatenate([self.pair_good, good])[order]
            known = np.searchsorted(self.pair_keys, keys)
        return self.pair_good[known]

    def _reached(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if token not in self.whole:
            self.whole[token] = self.merge(self.text[token]) == [token]
        return self.whole[token]

    def learn(self, new: list[str]) -> None:
        """Encode words that aren't remembered yet. Very long ones are merged at once: there a cover takes more steps than merging."""
        for w in [w for w in new if len(w) > LONG_WORD]:
            self.words[w] = np.array(self.merge(w.encode()), np.int32).tobytes()
        new = [w for w in new if len(w) <= LONG_WORD]
        if not new:
            return
        raw = [w.encode() for w in new]
        sizes = np.array([len(w) for w in raw])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raw), np.uint8)
        owner, tokens = self._cover(data, ends - sizes, ends)
        bad = np.zeros(len(new), bool)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inner):
            good = self._compatible(tokens[inner], tokens[inner + 1])
            bad[owner[inner[~good]]] = True
        kinds = np.unique(tokens)
        wrong = kinds[[not self._reached(t) for t in kinds.tolist()]]
        if len(wrong):
            bad[owner[np.isin(tokens, wrong)]] = True
        heads = (4 * np.searchsorted(owner, np.arange(len(new) + 1))).tolist()
        listed = tokens.astype(np.int32).tobytes()
        for i, w in enumerate(new):
            self.words[w] = np.array(self.merge(raw[i]), np.int32).tobytes() if bad[i] else listed[heads[i] : heads[i + 1]]

    def pieces(self, text: str) -> list[str | int]:
        """The words of a text, with special tokens' ids between them."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str | int] = []
        at = 0
        for m in self.special_pattern.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.pieces(t) for t in texts]
        found = set().union(*cut)
        special = {w: np.int32(w).tobytes() for w in found if isinstance(w, int)}
        missing = [w for w in found if w not in self.words and w not in special]
        if missing and len(self.words) + len(missing) > KEPT_WORDS:
            self.words = {w: self.words[w] for w in found if w in self.words}
        if missing:
            self.learn(missing)
        known = self.words | special if special else self.words
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Text of token ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        sizes = self.lengths[ids]
        total = int(sizes.sum())
        shift = np.repeat(self.begins[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[shift + np.arange(total)].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _tokenizer(spec: str) -> ByteBpe:
    return ByteBpe(spec)


def _spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _groups(column: pa.Array, limit: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in lists of about limit characters (null: empty)."""
    held: list[str] = []
    size = 0
    for i in range(len(column)):
        text = column[i].as_py() or ""
        held.append(text)
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def default_vocabulary() -> str:
    """Path of the byte-level vocabulary of 50,257 tokens that is installed here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "token_ids", check_col: str | None = None) -> DataFrame:
    """Add ids_col array<int>: the tokens of each whole text, without special tokens added.

    With check_col a boolean column of that name tells whether the tokens
    decode to the text again.

    Strings of special tokens in a text become those tokens, as the library
    does by default. Null and empty texts have no tokens. Rows keep all other
    columns, repeated rows and nulls in them included; a column named ids_col
    is replaced. Memory follows the longest text, not the table.
    """
    spec = _spec(vocabulary)
    added = [ids_col, *([check_col] if check_col else [])]
    base = docs.drop(*[c for c in added if c in docs.columns])
    schema = base.withColumn(ids_col, F.lit(None).cast("array<int>"))
    schema = (schema.withColumn(check_col, F.lit(None).cast("boolean")) if check_col else schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(text_col)):
                ids = bpe.encode(texts)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids)))
                part = batch.slice(at, len(texts))
                at += len(texts)
                columns = [*part.columns, column]
                if check_col:
                    columns.append(pa.array([bpe.decode(x) == t for x, t in zip(ids, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *added])

    return base.mapInArrow(freed(run), schema)


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Add text_col: the text of each row's token ids, special tokens included. Null ids: empty text."""
    spec = _spec(vocabulary)
    base = docs.drop(text_col) if text_col in docs.columns else docs
    schema = base.withColumn(text_col, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec)
        for batch in batches:
            column = batch.column(ids_col)
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = column.slice(at, step)
                texts = [bpe.decode(np.asarray(lists[i].values, np.int64)) if lists[i].is_valid and len(lists[i]) else "" for i in range(len(lists))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text_col])

    return base.mapInArrow(freed(run), schema)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass: id_col, n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the
    decoded text in UTF-8. Null texts count as empty; one row per row of docs.
    """
    spec = _spec(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(spec)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(1)):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(",".join(map(bpe.decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(texts)

    return docs.select(id_col, text_col).mapInArrow(freed(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
