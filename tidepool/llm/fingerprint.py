"""Threshold-scaled sketches of documents, compared without their texts.

A document's shingles (runs of five words) are hashed, and every hash below a
fixed fraction of the hash range is retained, whatever the text's length. So
the sketch grows with the text, sketches of very unequal documents can be
compared and merged, and a shorter one's containment in a longer one is
estimated without bias. A short text may keep no hash at all; a mark of its
whole shingle set then tells whether another such text is equal.

A fingerprint is a string: the threshold in hex, the mark, then the hashes in
ascending order, twelve hex digits each, with colons between the three.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .cluster import partitions
from .words import Hasher, distinct, mix, shingles, slices, words

SHINGLE = 5
#: Share of the hash range that sketches retain.
FRACTION = 1 / 4
_BITS = 48
_ALL = 1 << _BITS


class Sketch(NamedTuple):
    """Hashes below limit, ascending; mark names the whole shingle set (empty where it isn't known)."""

    limit: int
    hashes: np.ndarray
    mark: str


def sketches(texts: list[str], k: int = SHINGLE, fraction: float = FRACTION) -> list[Sketch]:
    """The sketch of each text; a text without words has no hashes."""
    limit = int(_ALL * fraction)
    out: list[Sketch] = []
    for part in slices(pa.array(texts, pa.large_string())):
        found = words(part)
        n = len(part.starts)
        docs, hashes = shingles(Hasher(part.data).spans(found.begin, found.end), found, k)
        hashes, bounds = distinct(docs, hashes >> np.uint64(64 - _BITS), n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes))])
        below = hashes < np.uint64(limit)
        own = hashes[below].astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(below)])[bounds]
        marks = (total[bounds[1:]] - total[bounds[:-1]]).tolist()
        out += [Sketch(limit, own[cuts[i] : cuts[i + 1]], f"{marks[i]:016x}") for i in range(n)]
    return out


def to_text(sketch: Sketch) -> str:
    digits = sketch.hashes.astype(">i8").tobytes().hex(" ", 8)[4:].replace(" 0000", "") if len(sketch.hashes) else ""
    return f"{sketch.limit:x}:{sketch.mark}:{digits}"


def from_text(text: str) -> Sketch:
    limit, mark, digits = text.split(":")
    return Sketch(int(limit, 16), np.array([int(digits[i : i + 12], 16) for i in range(0, len(digits), 12)], np.int64), mark)


def _shared(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    limit = min(a.limit, b.limit)
    x, y = a.hashes[: np.searchsorted(a.hashes, limit)], b.hashes[: np.searchsorted(b.hashes, limit)]
    if not len(x) or not len(y):
        return 0, len(x), len(y)
    spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[spot] == x).sum()), len(x), len(y)


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity of the shingle sets; sets of one mark are equal, and of two sets without hashes nothing else is known (0)."""
    if a.mark and a.mark == b.mark:
        return 1.0
    both, x, y = _shared(a, b)
    return both / (x + y - both) if x + y else 0.0


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has; 1 for sets of one mark, else 0 where a has no hashes."""
    if a.mark and a.mark == b.mark:
        return 1.0
    both, x, _ = _shared(a, b)
    return both / x if x else 0.0


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of the union of two shingle sets; its mark isn't known."""
    limit = min(a.limit, b.limit)
    union = np.union1d(a.hashes, b.hashes)
    return Sketch(limit, union[: np.searchsorted(union, limit)], "")


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Add out_col: the fingerprint of each whole text (null: empty). Other columns and repeated rows stay."""
    base = docs.drop(out_col) if out_col in docs.columns else docs

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([to_text(s) for s in sketches(texts.fillna("").tolist())], dtype=object)

    return base.withColumn(out_col, run(F.col(text_col)))


def _with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, __bucket, __ahead): buckets of consecutive ids, each with the first rows of the next bucket as a look ahead.

    Each bucket is a partition. Bucket bounds are quantiles of the ids, one for each partition; the first
    id of each bucket comes to the driver, as many numbers as there are
    partitions. The text is shuffled once. Null ids are the smallest.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    ids = docs.select(F.coalesce(F.col(id_col), F.lit(-(2**63))).cast("long").alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] or []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy(), side="right").astype(np.int32))

    heads = sorted((r["b"], r["id"]) for r in ids.groupBy(bucket_of("id").alias("b")).agg(F.min("id").alias("id")).collect())
    ahead = {id_: heads[i - 1][0] for i, (_, id_) in enumerate(heads)}
    head_ids = np.array(sorted(ahead), np.int64)
    head_to = np.array([ahead[i] for i in head_ids.tolist()], np.int32)

    @F.pandas_udf("array<int>")
    def targets(x: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, x.to_numpy(), side="right").tolist()
        spot = np.minimum(np.searchsorted(head_ids, x.to_numpy()), len(head_ids) - 1)
        head = head_ids[spot] == x.to_numpy()
        return pd.Series([[b, int(head_to[s])] if h else [b] for b, s, h in zip(own, spot, head)])

    key = F.coalesce(F.col(id_col), F.lit(-(2**63))).cast("long")
    dealt = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col), key.alias("__key"))
    dealt = dealt.select(id_col, text_col, "__key", F.posexplode(targets("__key")).alias("__ahead", "__bucket"))
    return dealt.repartitionById(n, F.col("__bucket")).sortWithinPartitions("__bucket", "__ahead", "__key", text_col)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, its edited text and the next document's, and compare them.

    The edited text has the last floor(n/4) of its n code points replaced by
    the first as many (or all) of the next document's, by ascending id; after
    the last comes the first. Rows of equal id follow each other by text. A
    single document is its own next. Null texts are empty, null ids first; an
    empty table gives no rows. Returns id_col, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, contained_edited.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double"
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited"]

    def compare(rows: list[tuple], id_type: pa.DataType) -> tuple[pa.RecordBatch, list[tuple]]:
        """Results of all rows that are followed by their next; the others."""
        own = sketches([r[1] for r in rows])
        pairs = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
        edited = []
        for i in pairs:
            text = rows[i][1]
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + rows[i + 1][1][:cut])
        changed = sketches(edited)
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in pairs], id_type),
                pa.array([len(rows[i][1]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([to_text(own[i]) for i in pairs], pa.string()),
                pa.array([to_text(s) for s in changed], pa.string()),
                pa.array([likeness(own[i], s) for i, s in zip(pairs, changed)], pa.float64()),
                pa.array([likeness(own[i], own[i + 1]) for i in pairs], pa.float64()),
                pa.array([containment(own[i], s) for i, s in zip(pairs, changed)], pa.float64()),
            ],
            names=names,
        )
        return batch, [rows[-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            ids, buckets, aheads = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (id_col, "__bucket", "__ahead"))
            texts = batch.column(batch.schema.get_field_index(text_col))
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                held.append((ids[i], text, buckets[i], aheads[i]))
                size += len(text)
                if size > 1 << 19:
                    out, held = compare(held, id_type)
                    size = 0
                    yield out
        if len(held) > 1:
            yield compare(held, id_type)[0]

    return _with_next(docs, id_col, text_col).mapInArrow(run, columns)
