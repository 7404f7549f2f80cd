"""Language model: hashed maximum entropy with a class-factored softmax.

A token is predicted in two steps, P(class | context) and P(member | class,
context), each a softmax over sums of feature rows. Features of the context
are the word before, the word before that (a skip feature), the pair of both,
and the first with the third. Every word of the corpus is a context: words and
pairs are hashed to rows, whose number grows with the square root of the
training tokens (a power of two), so a larger corpus tells more contexts apart.
The CLASSES x MEMBERS cells hold the most frequent words; class 0 holds
buckets of all other words, by their first bytes. Within a bucket a word has
its discounted share of the bucket's training tokens, and what the discount
takes is the share of unknown words, so probabilities of all tokens of the
vocabulary and of one unknown token add up to one.

Counts are taken over all training texts. Gradients are distributed: in each
round every trainer goes over its share of a fresh part of the training texts
with small steps from the common weights, and Spark takes the mean of the changes
of each row over the trainers that touched it, so a row's change doesn't shrink
with the number of trainers. Every position of every training text gives a
gradient step.

Scoring runs in batches of positions. Words too rare for the table that each
task holds (at most TABLE_WORDS entries) are joined to their counts by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .cluster import cut
from .words import Hasher, Slice, mix, slices, words

CLASSES, MEMBERS = 32, 64
CELLS = CLASSES * MEMBERS
#: Rows of each hashed feature at least.
LEAST_HASHED = 1 << 12
#: Entries of the count table that each task holds.
TABLE_WORDS = 1 << 20
ROUNDS = 2
#: Trainers, at least; more only as the training tokens grow, never with the machines, so that a table gives one model on any cluster.
TRAINERS = 16
TOKENS_EACH = 1 << 26
#: Parts in which a table's changes travel.
BLOCKS = 32
_END = np.uint64(0x1B873593CC9E2D51)


def hashed_rows(n_tokens: int) -> int:
    """Rows of each hashed feature: the power of two at or above the square root of the training tokens."""
    return max(LEAST_HASHED, 1 << max(0, int(np.sqrt(n_tokens)) - 1).bit_length())


def _tokens(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bucket, document) of each token: the words in lower case, then an end for each text."""
    found = words(part)
    n = len(part.starts)
    hasher = Hasher(part.data, lower=True)
    own = hasher.spans(found.begin, found.end)
    own = np.where(own == _END, own + np.uint64(1), own)
    head = hasher.spans(found.begin, np.minimum(found.end, found.begin + 2))
    bucket = (head % np.uint64(MEMBERS)).astype(np.int64)
    total = len(own) + n
    at = np.arange(len(own)) + found.owner()
    hashes = np.full(total, _END, np.uint64)
    buckets = np.zeros(total, np.int64)
    hashes[at], buckets[at] = own, bucket
    return hashes, buckets, np.repeat(np.arange(n), found.counts + 1)


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, bucket, c) over all rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for part in slices(batch.column(0)):
                hashes, buckets, _ = _tokens(part)
                known, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                held.append((known, buckets[first], counts))
            if not held:
                continue
            hashes, buckets, counts = (np.concatenate(x) for x in zip(*held))
            known, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            total = np.bincount(inverse, weights=counts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(buckets[first].astype(np.int32)), pa.array(total)], names=["word", "bucket", "c"])

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "word long, bucket int, c long")
    return rows.groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("c").alias("c"))


def _row_sums(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    out = table.take(rows[0], axis=0)
    for r in rows[1:]:
        out += table.take(r, axis=0)
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    if len(logits) and max(logits.max(), -logits.min()) > 60:  # else no power or sum leaves the range of a float
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(logits.shape[1], logits.dtype))[:, None]
    return logits


@dataclass
class Model:
    """Count table, vocabulary and weights; n_tokens and n_words of the training tokens."""

    words: np.ndarray
    counts: np.ndarray
    cells: np.ndarray
    n_tokens: int
    n_words: int
    discount: float
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray
    complete: bool
    hashed: int = LEAST_HASHED
    class_rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    member_rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def __post_init__(self):
        self.class_rows = np.zeros((1 + 4 * self.hashed, CLASSES), np.float32)
        self.member_rows = np.zeros((CLASSES + 2 * self.hashed, MEMBERS), np.float32)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, cell) of each word; both -1 for words outside the table."""
        if not len(self.words):
            return np.full(len(hashes), -1, np.int64), np.full(len(hashes), -1, np.int64)
        known, inverse = np.unique(hashes, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.words, known), len(self.words) - 1)
        same = self.words[spot] == known
        counts = np.where(same, self.counts[spot], -1)
        cells = np.where(same, self.cells[spot], -1)
        return counts[inverse], cells[inverse]

    @staticmethod
    def before(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The three words before each token, the end where a text starts."""
        back = np.full((3, len(hashes)), _END, np.uint64)
        for k in (1, 2, 3):
            same = docs[k:] == docs[:-k]
            back[k - 1, k:][same] = hashes[:-k][same]
        return back

    def _row(self, values: np.ndarray) -> np.ndarray:
        return (values & np.uint64(self.hashed - 1)).astype(np.int64)

    def class_features(self, back: np.ndarray) -> list[np.ndarray]:
        """Rows of the class weights for each position."""
        h = self.hashed
        pair = lambda a, b: self._row(mix(a * np.uint64(0x9E3779B97F4A7C15) + b))
        return [np.zeros(back.shape[1], np.int64), 1 + self._row(back[0]), 1 + h + self._row(back[1]), 1 + 2 * h + pair(back[0], back[1]), 1 + 3 * h + pair(back[0], back[2])]

    def member_features(self, classes: np.ndarray, back: np.ndarray) -> list[np.ndarray]:
        """Rows of the member weights for each position of a class."""
        h = self.hashed
        of = lambda b: self._row(mix(b + (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)))
        return [classes, CLASSES + of(back[0]), CLASSES + h + of(back[1])]

    def log_probabilities(self, ids: np.ndarray, hashes: np.ndarray, docs: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(cell) of each position, and log10 P(unknown word) at the positions asked for (0 elsewhere)."""
        out, missing = np.zeros(len(ids)), np.zeros(len(ids))
        back = self.before(hashes, docs)
        free = np.where(self.bucket_tokens > 0, self.discount * self.bucket_words / np.maximum(self.bucket_tokens, 1), 1.0).astype(np.float32)
        for low in range(0, len(ids), 4096):
            at = slice(low, low + 4096)
            target = ids[at]
            classes, members = target // MEMBERS, target % MEMBERS
            p = _softmax(_row_sums(self.class_rows, self.class_features(back[:, at])))
            each = np.arange(len(target))
            q = _softmax(_row_sums(self.member_rows, self.member_features(classes, back[:, at])))
            out[at] = np.log10(np.maximum(p[each, classes] * q[each, members], 1e-30))
            ask = np.flatnonzero(unknown[at])
            if len(ask):  # unknown words are in class 0, and so q is its softmax
                missing[low + ask] = np.log10(np.maximum(p[ask, 0] * (q[ask] @ free), 1e-30))
        return out, missing


class _Trainer:
    """Small adaptive gradient steps from common weights."""

    def __init__(self, model: Model, rate: float = 0.08):
        self.model, self.rate = model, rate
        self.a, self.b = model.class_rows.copy(), model.member_rows.copy()
        self.seen_a, self.seen_b = np.full(len(self.a), 1e-3, np.float32), np.full(len(self.b), 1e-3, np.float32)
        self.n = 0

    def _apply(self, table: np.ndarray, seen: np.ndarray, rows: list[np.ndarray], gradient: np.ndarray) -> None:
        """One step of every row that the features name; no row is in two features, so all are sorted at once."""
        every = np.concatenate(rows)
        low = every.min()
        near = every.max() - low < 1 << 16  # small numbers are sorted faster
        order = np.argsort((every - low).astype(np.uint16) if near else every, kind="stable")
        every = every[order]
        at = order % len(gradient)
        first = np.r_[True, every[1:] != every[:-1]]
        heads = np.flatnonzero(first)
        own, times = every[heads], np.diff(np.append(heads, len(every)))
        g = gradient.take(at[heads], axis=0)
        often = np.flatnonzero(times > 1)
        if len(often):  # rows of one position need no sum
            n = times[often]
            g[often] = np.add.reduceat(gradient.take(at[np.repeat(times > 1, times)], axis=0), np.cumsum(n) - n, axis=0)
        self._move(table, seen, own, g)

    def _move(self, table: np.ndarray, seen: np.ndarray, own: np.ndarray, g: np.ndarray) -> None:
        total = seen[own] + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
        seen[own] = total
        g *= (self.rate / np.sqrt(total)).astype(g.dtype)[:, None]
        table[own] = table.take(own, axis=0) - g

    def step(self, target: np.ndarray, back: np.ndarray) -> None:
        rows = self.model.class_features(back)  # the first is one row for all
        each, classes = np.arange(len(target)), target // MEMBERS
        g = _softmax(_row_sums(self.a, rows))
        g[each, classes] -= 1
        self._move(self.a, self.seen_a, np.zeros(1, np.int64), np.ones((1, len(g)), g.dtype) @ g)
        self._apply(self.a, self.seen_a, rows[1:], g)
        rows_b = self.model.member_features(classes, back)
        g = _softmax(_row_sums(self.b, rows_b))
        g[each, target % MEMBERS] -= 1
        self._apply(self.b, self.seen_b, rows_b, g)
        self.n += len(target)


def _ids(model: Model, hashes: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count or -1, cell) of each token; words without a cell of their own are in their bucket's."""
    counts, cells = model.look_up(hashes)
    return counts, np.where(cells >= 0, cells, buckets)


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_rows: Column | None = None) -> tuple[Model, DataFrame]:
    """Fit on the rows for which train_rows holds; also returns the counts of all training words, (word, bucket, c).

    Without training rows the model knows no word and gives every token the
    probability of an unknown one.
    """
    rows = docs if train_rows is None else docs.filter(train_rows)
    counts = cut(count_words(rows, text_col))
    level = F.floor(F.log2(F.col("c").cast("double")) * 16)
    totals = counts.agg(F.sum("c").alias("n"), F.count("c").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")).first()
    n, v = totals["n"] or 0, totals["v"]
    left, least = TABLE_WORDS, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # a few hundred levels at most
        if r["count"] > left:
            break
        left, least = left - r["count"], r["level"]
    table = counts.filter(level >= F.lit(least if least is not None else 1 << 30)).select("word", "bucket", "c").toArrow()  # at most TABLE_WORDS
    hashes = np.array(table["word"].to_numpy(), np.int64).view(np.uint64)
    c, bucket = np.array(table["c"].to_numpy()), np.array(table["bucket"].to_numpy())
    order = np.argsort(hashes)
    hashes, c, bucket = hashes[order], c[order], bucket[order]
    cells = np.full(len(hashes), -1, np.int32)
    top = np.lexsort((hashes, -c))[: CELLS - MEMBERS]
    cells[top] = MEMBERS + np.arange(len(top))
    # Tokens and words of each bucket, those with a cell of their own taken out.
    sums = np.zeros((2, MEMBERS))
    for r in counts.groupBy("bucket").agg(F.sum("c").alias("c"), F.count("c").alias("n")).collect():
        sums[:, r["bucket"]] = r["c"], r["n"]
    np.subtract.at(sums[0], bucket[top], c[top])
    np.subtract.at(sums[1], bucket[top], 1)
    n1, n2 = totals["n1"] or 0, totals["n2"] or 0
    model = Model(hashes, c, cells, n, v, n1 / (n1 + 2 * n2) if n1 and n2 else 0.5, sums[0], sums[1], len(hashes) == v, hashed_rows(n))
    mass = np.zeros(CELLS)
    mass[:MEMBERS] = sums[0]
    mass[cells[top]] = c[top]
    mass = (mass + 0.01).reshape(CLASSES, MEMBERS)
    model.class_rows[0] = np.log(mass.sum(axis=1) / mass.sum())
    model.member_rows[:CLASSES] = np.log(mass / mass.sum(axis=1, keepdims=True))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = _Trainer(model)
        for batch in batches:
            for part in slices(batch.column(0)):
                tokens, buckets, owner = _tokens(part)
                _, ids = _ids(model, tokens, buckets)
                back = model.before(tokens, owner)
                for low in range(0, len(ids), 1024):
                    at = slice(low, low + 1024)
                    trainer.step(ids[at], back[:, at])
        if trainer.n:
            for name, new, old in ((0, trainer.a, model.class_rows), (1, trainer.b, model.member_rows)):
                rows_of = np.array_split(np.arange(len(old)), BLOCKS)
                parts = [(new[r] - old[r]).astype(np.float16).tobytes() for r in rows_of]
                yield pa.RecordBatch.from_arrays([pa.array([name] * BLOCKS, pa.int32()), pa.array(range(BLOCKS), pa.int32()), pa.array([trainer.n] * BLOCKS, pa.int64()), pa.array(parts, pa.binary())], names=["table", "block", "n", "change"])

    def mean(group: pa.Table) -> pa.Table:
        """The mean of each row's change over the trainers that have one, by their positions."""
        width = (CLASSES, MEMBERS)[group["table"][0].as_py()]
        total = touched = 0.0
        for weight, part in zip(group["n"].to_pylist(), group["change"]):
            change = np.frombuffer(part.as_buffer(), np.float16).astype(np.float32).reshape(-1, width)
            total = total + np.float32(weight) * change
            touched = touched + np.float32(weight) * change.any(axis=1)
        out = (total / np.maximum(touched, 1)[:, None]).astype(np.float32)
        return pa.table({"table": group["table"].slice(0, 1), "block": group["block"].slice(0, 1), "change": pa.array([out.tobytes()], pa.binary())})

    if n:
        trainers = max(TRAINERS, n // TOKENS_EACH)
        text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
        for t in range(ROUNDS):
            fresh = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(ROUNDS)) == t).select(text).coalesce(trainers)
            got = fresh.mapInArrow(train, "table int, block int, n long, change binary").groupBy("table", "block").applyInArrow(mean, "table int, block int, change binary").collect()
            for name, rows_ in ((0, model.class_rows), (1, model.member_rows)):
                change = [np.frombuffer(r["change"], np.float32) for r in sorted(got, key=lambda r: r["block"]) if r["table"] == name]
                if change:
                    rows_ += np.concatenate(change).reshape(rows_.shape)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score) of each row of docs.

    n_known counts the tokens that training has; base_score is the smoothed
    unigram's log10 probability of the text, score the model's. Null and empty
    texts are their end alone. Repeated rows come as often as they are; an
    empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "name", "word", "rows", "n", "known", "base", "score", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_log = np.log10(np.maximum(model.bucket_tokens, 1.0))
        for batch in batches:
            for part in slices(batch.column(1)):
                n = part.last - part.first
                ids_column = batch.column(0).slice(part.first, n)
                text_names = np.array([xxhash.xxh64_intdigest(part.data[a:b].tobytes()) & 0x7FFFFFFFFFFFFFFF for a, b in zip(part.starts, part.ends)], np.int64)
                tokens, buckets, owner = _tokens(part)
                c, ids = _ids(model, tokens, buckets)
                rare = ids < MEMBERS
                absent = c < 0
                log_p, log_unknown = model.log_probabilities(ids, tokens, owner, absent)
                # A rare word's part of its bucket; what a task can't know is left to the join.
                log_p = np.where(rare, log_p - bucket_log[np.minimum(ids, MEMBERS - 1)], log_p)
                here = ~absent
                value = np.where(here & rare, log_p + np.log10(np.maximum(c - model.discount, 1e-9)), log_p)
                sums = lambda x: np.bincount(owner, weights=x, minlength=n)
                unknown = absent & model.complete
                yield pa.RecordBatch.from_arrays(
                    [
                        ids_column, pa.array(text_names), pa.nulls(n, pa.int64()), pa.array(np.ones(n, np.int32)), pa.array(np.bincount(owner, minlength=n)),
                        pa.array(sums(here).astype(np.int64)), pa.array(sums(np.where(here, np.log10(np.maximum(c, 0) + 1.0), 0.0))),
                        pa.array(sums(np.where(here, value, 0.0) + np.where(unknown, log_unknown, 0.0))), pa.array(np.zeros(n)),
                    ],
                    names=names,
                )
                ask = np.flatnonzero(absent & ~unknown)
                if not len(ask):
                    continue
                order = ask[np.lexsort((tokens[ask], owner[ask]))]
                heads = np.flatnonzero(np.r_[True, (np.diff(owner[order]) != 0) | (tokens[order][1:] != tokens[order][:-1])])
                mine, m = owner[order][heads], len(heads)
                times = np.diff(np.append(heads, len(order)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids_column.take(pa.array(mine)), pa.array(text_names[mine]), pa.array(tokens[order][heads].view(np.int64)), pa.array(np.zeros(m, np.int32)),
                        pa.array(times), pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m)), pa.array(np.add.reduceat(log_p[order], heads)), pa.array(np.add.reduceat(log_unknown[order], heads)),
                    ],
                    names=names,
                )

    schema = f"id {kind}, name long, word long, rows int, n long, known long, base double, score double, other double"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)
    asked = rows
    if not model.complete:
        c = F.col("c")
        found = rows.join(counts.select("word", "c"), "word", "left")
        own = F.col("word").isNull()
        asked = found.select(
            "id",
            "name",
            "rows",
            F.when(own, F.col("n")).otherwise(0).alias("n"),
            F.when(own, F.col("known")).when(c.isNotNull(), F.col("n")).otherwise(0).alias("known"),
            F.when(own, F.col("base")).when(c.isNotNull(), F.col("n") * F.log10(c + 1.0)).otherwise(0.0).alias("base"),
            F.when(own, F.col("score")).when(c.isNotNull(), F.col("score") + F.col("n") * F.log10(c - F.lit(model.discount))).otherwise(F.col("other")).alias("score"),
        )
    summed = asked.groupBy("id", "name").agg(F.sum("rows").alias("rows"), *[F.sum(x).alias(x) for x in ("n", "known", "base", "score")])
    # Equal rows were added up together: each gets its part.
    per_token = float(np.log10(model.n_tokens + model.n_words + 1))
    return summed.select(
        F.col("id").alias(id_col),
        F.expr("n div rows").alias("n_tokens"),
        F.expr("known div rows").alias("n_known"),
        (F.col("base") / F.col("rows") - F.expr("n div rows") * F.lit(per_token)).alias("base_score"),
        (F.col("score") / F.col("rows")).alias("score"),
        F.explode(F.expr("sequence(1, int(rows))")).alias("copy"),
    ).drop("copy")
