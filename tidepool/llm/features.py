"""Hashed terms of texts and bounded labelled samples, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .cluster import cut
from .words import Slice, slices
from .workers import freed

#: (slice) -> (document within the slice, 64-bit term hash), repeats allowed
Terms = Callable[[Slice], tuple[np.ndarray, np.ndarray]]

_MASK_BITS = 21


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, train: Column, limit: int) -> DataFrame:
    """(id, label) of at most limit labelled training rows, those of the smallest hash of the id: the same in every run."""
    rows = labels.filter(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    return rows.orderBy(F.xxhash64("__id"), "__id").limit(limit)


class Lookup:
    """Positions of known hashes: a small bit table first, then a binary search of what passes it."""

    def __init__(self, known: np.ndarray):
        self.known = known  # ascending
        self.table = np.zeros(1 << _MASK_BITS, bool)
        self.table[(known >> np.uint64(64 - _MASK_BITS)).astype(np.int64)] = True

    def hits(self, docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, position) of each hash that is known, without repeats, by document."""
        maybe = np.flatnonzero(self.table[(hashes >> np.uint64(64 - _MASK_BITS)).astype(np.int64)])
        if not len(maybe) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spot = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        same = self.known[spot] == hashes[maybe]
        pairs = np.unique(docs[maybe[same]] * np.int64(len(self.known)) + spot[same])
        return pairs // len(self.known), pairs % len(self.known)


def _sampled(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __label, __text), as many rows as the sample at most: of rows of one id the one of the smallest text."""
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    found = rows.join(F.broadcast(sample), "__id")  # the sample has a limit
    return found.groupBy("__id").agg(F.first("__label").alias("__label"), F.min("__text").alias("__text"))


def _distinct_terms(part: Slice, terms: Terms) -> Iterator[np.ndarray]:
    docs, hashes = terms(part)
    order = np.argsort(docs, kind="stable")
    hashes, bounds = hashes[order], np.searchsorted(docs[order], np.arange(part.last - part.first + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield np.unique(hashes[a:b])


@dataclass
class Fitting:
    """What a fit sees: selected terms (ascending hashes), their positive and negative documents, and each document's terms and label."""

    known: np.ndarray
    positive: np.ndarray
    negative: np.ndarray
    rows: list[np.ndarray]
    labels: np.ndarray


def gather(
    docs: DataFrame, sample: DataFrame, *, id_col: str, text_col: str, terms: Terms, least: int, most: int, strength: float = 0.0, frequent: float = 1.0
) -> Fitting:
    """Count terms by label over the sample, select, and read the sample's documents in the selected terms.

    Terms of at least `least` documents are selected if they are in a share of
    `frequent` of the documents, whatever the label, or have a chi-squared of
    at least `strength` with it; of more than `most` the frequent ones first,
    then the strongest. The counts are summed by Spark; the sample's limit and
    `most` bound what comes to the driver.
    """
    rows = cut(_sampled(docs, cut(sample), id_col, text_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), bool)
            found, marks = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for part in slices(batch.column(2)):
                for label, own in zip(labels[part.first : part.last], _distinct_terms(part, terms)):
                    found.append(own)
                    marks.append(np.full(len(own), label))
            known, inverse = np.unique(np.concatenate(found), return_inverse=True)
            positive = np.bincount(inverse, weights=np.concatenate(marks), minlength=len(known)).astype(np.int64)
            total = np.bincount(inverse, minlength=len(known)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(positive), pa.array(total)], names=["term", "positive", "total"])

    sizes = rows.agg(F.count("__label").alias("n"), F.coalesce(F.sum("__label"), F.lit(0)).alias("p")).first()
    n, p = sizes["n"], max(1, sizes["p"])
    counts = rows.mapInArrow(freed(count), "term long, positive long, total long").groupBy("term").agg(F.sum("positive").alias("positive"), F.sum("total").alias("total"))
    share = min(p / max(1, n), 1 - 1e-9)
    expected = F.col("total") * F.lit(share)
    power = F.pow(F.col("positive") - expected, 2) / (expected * F.lit(1 - share))
    often = F.col("total") >= frequent * n
    chosen = counts.filter(F.col("total") >= least).withColumn("power", power).filter(often | (F.col("power") >= strength))
    table = chosen.orderBy(F.desc(often), F.desc("power"), "term").limit(most).toArrow()
    known = np.array(table["term"].to_numpy(), np.int64).view(np.uint64)
    order = np.argsort(known)
    known = known[order]
    positive, total = (np.array(table[c].to_numpy())[order] for c in ("positive", "total"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(known)
        for batch in batches:
            for part in slices(batch.column(2)):
                n = part.last - part.first
                docs_, at = lookup.hits(*terms(part))
                bounds = np.searchsorted(docs_, np.arange(n + 1))
                blobs = [at[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, n), batch.column(1).slice(part.first, n), pa.array(blobs, pa.binary())],
                    names=["id", "label", "terms"],
                )

    kind = rows.schema["__id"].dataType.simpleString()
    got = rows.mapInArrow(freed(read), f"id {kind}, label int, terms binary").orderBy("id", "label", "terms").toArrow()
    at, labels = [np.frombuffer(x.as_py(), np.int32) for x in got["terms"]], np.array(got["label"].to_pylist(), np.int64)
    return Fitting(known, positive, total - positive, at, labels)


def platt(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) with sigmoid(a * margin + b) fitted to the labels by Newton steps that are halved until the loss falls, with smoothed targets; a is not negative."""
    p, q = int(labels.sum()), int(len(labels) - labels.sum())
    if not p or not q:
        return 0.0, float(np.log((p + 1) / (q + 1)))
    target = np.where(labels == 1, (p + 1) / (p + 2), 1 / (q + 2))

    def loss(x: np.ndarray) -> float:
        z = x[0] * margins + x[1]
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-4 * x[0] ** 2)

    at = np.array([0.0, float(np.log((p + 1) / (q + 1)))])
    now = loss(at)
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(at[0] * margins + at[1], -30, 30)))
        g = np.array([((s - target) * margins).sum() + 1e-3 * at[0], (s - target).sum()])
        w = np.maximum(s * (1 - s), 1e-9)
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-9]])
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-9 and loss(at - size * step) > now:
            size /= 2
        if size <= 1e-9:
            break
        at, before = at - size * step, now
        now = loss(at)
        if before - now < 1e-9:
            break
    return max(0.0, float(at[0])), float(at[1])
