"""Benchmark decontamination: test phrases are searched in an FM-index of each training shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import fmindex
from .cluster import cut, discard
from .words import Hasher, Slice, Words, slices, words

#: Text bytes of a shard; one longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: (phrase, item) pairs that are searched, and sent to the tasks, at a time: about 100 bytes each.
BLOCK = 1 << 17

#: Bytes of words: digits, letters, all beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _hashed(part: Slice) -> tuple[Words, np.ndarray]:
    found = words(part, _WORD)
    return found, Hasher(part.data, lower=True).spans(found.begin, found.end)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a shard: the ids and numbers of words of its documents and the parts of its index. Null texts have no words. Not lazy when written: write it, then search it as often as needed."""
    schema = T.StructType().add("shard", "long").add("ids", T.ArrayType(docs.schema[id_col].dataType)).add("counts", T.ArrayType(T.LongType())).add("n", "long")
    for name in ("vocabulary", "starts", "levels", "marks", "samples"):
        schema = schema.add(name, "binary")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            ids = batch.column(0)
            for part in slices(batch.column(1), shard_bytes):
                found, hashes = _hashed(part)
                built = fmindex.build(hashes, found.counts)
                whole = np.array([0, part.last - part.first], np.int32)
                row = {
                    "shard": pa.array([(TaskContext.get().partitionId() << 32) + made]),
                    "ids": pa.ListArray.from_arrays(whole, ids.slice(part.first, part.last - part.first)),
                    "counts": pa.ListArray.from_arrays(whole, pa.array(found.counts.astype(np.int64))),
                    "n": pa.array([built.n]),
                }
                made += 1
                yield pa.RecordBatch.from_pydict(row | {k: pa.array([v], pa.binary()) for k, v in built.dump().items()})

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(index, schema)


def phrases_of(items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, phrase): the distinct runs of k words of each item as word hashes; an item of fewer words, but not none, is one run. item is the id as text; a null id is an empty text."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for part in slices(batch.column(1)):
                found, hashes = _hashed(part)
                runs = np.where(found.counts == 0, 0, np.maximum(found.counts - k + 1, 1))
                sizes = np.repeat(np.minimum(found.counts, k), runs)
                firsts = np.repeat(found.low - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
                ends = np.cumsum(sizes)
                flat = hashes[np.repeat(firsts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
                phrase = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[part.first : part.last], runs), pa.string()), phrase], names=["item", "phrase"])

    named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    return named.mapInArrow(windows, "item string, phrase array<long>").distinct()


class _Phrases:
    """A block of (phrase, item) pairs: distinct phrases, and the items of each."""

    def __init__(self, pairs: pa.Table):
        phrases = pairs.column("phrase").combine_chunks()
        lengths = np.diff(phrases.offsets.to_numpy())
        table = np.zeros((len(lengths), lengths.max()), np.uint64)
        table[np.arange(lengths.max()) < lengths[:, None]] = phrases.flatten().to_numpy().view(np.uint64)
        keyed, of = np.unique(np.column_stack([lengths.astype(np.uint64), table]), axis=0, return_inverse=True)
        self.lengths, self.words = keyed[:, 0].astype(np.int64), np.ascontiguousarray(keyed[:, 1:])
        by = np.argsort(of, kind="stable")
        self.items = pairs.column("item").combine_chunks().take(pa.array(by))
        self.bounds = np.searchsorted(of[by], np.arange(len(keyed) + 1))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, member) of all members of ranges low .. high - 1."""
    sizes = high - low
    of = np.repeat(np.arange(len(low)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[of]


def _hits(index: fmindex.FMIndex, counts: np.ndarray, phrases: _Phrases) -> pa.RecordBatch | None:
    """(place, spans, items) of the documents of a shard that hold phrases: merged word ranges, half open, and the items whose phrases they hold."""
    low, high = index.search(phrases.words, phrases.lengths)
    of, rows = _ranges(low, high)
    if not len(rows):
        return None
    at, lengths = index.locate(rows), phrases.lengths[of]
    covered = np.zeros(index.n + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + lengths, -1)
    hit = np.cumsum(covered) > 0
    first, last = np.flatnonzero(hit & ~np.r_[False, hit[:-1]]), np.flatnonzero(~hit & np.r_[False, hit[:-1]])
    begins = np.cumsum(counts + 1) - counts - 1
    owner = np.searchsorted(begins, first, side="right") - 1
    pairs = np.unique((np.searchsorted(begins, at, side="right") - 1) * len(phrases.lengths) + of)
    docs, which = pairs // len(phrases.lengths), pairs % len(phrases.lengths)
    run, items = _ranges(phrases.bounds[which], phrases.bounds[which + 1])
    places = np.unique(owner)
    spans = pa.StructArray.from_arrays([pa.array(first - begins[owner]), pa.array(last - begins[owner])], names=["first", "last"])
    bounds = lambda of: pa.array(np.r_[np.searchsorted(of, places), len(of)].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(places), pa.ListArray.from_arrays(bounds(owner), spans), pa.ListArray.from_arrays(bounds(docs[run]), phrases.items.take(pa.array(items)))], names=["place", "spans", "items"]
    )


HITS = "shard long, place long, spans array<struct<first:long,last:long>>, items array<string>"


def find(index: DataFrame, windows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(shard, place, spans, items) of all documents that hold a phrase of windows (as phrases_of makes them), a row for each block of phrases.

    The phrases go to the shards in blocks of about `block` pairs, so their size in a task is bounded whatever the number of items.
    """
    spark = index.sparkSession
    windows = cut(windows)
    blocks = max(1, -(-windows.count() // block))
    numbered = cut(windows.withColumn("block", F.pmod(F.xxhash64("item", "phrase"), F.lit(blocks))))
    parts = []
    for b in range(blocks):
        pairs = numbered.filter(F.col("block") == b).select("item", "phrase").toArrow()  # about `block` rows
        if pairs.num_rows:
            parts.append(_found(index, _Phrases(pairs)))
    discard(windows)
    discard(numbered)
    if not parts:
        return spark.createDataFrame([], HITS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _found(index: DataFrame, phrases: _Phrases) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                known = fmindex.load(row["n"].as_py(), *(memoryview(row[c].as_buffer()) for c in ("vocabulary", "starts", "levels", "marks", "samples")))
                out = _hits(known, row["counts"].values.to_numpy(), phrases)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, row["shard"].as_py())), *out.columns], names=["shard", *out.schema.names])

    return index.drop("ids").mapInArrow(search, HITS)


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the spans of several blocks."""
    for batch in batches:
        rows = []
        for spans in batch.column(2).to_pylist():
            merged: list[dict] = []
            for s in sorted(spans, key=lambda s: s["first"]):
                if merged and s["first"] <= merged[-1]["last"]:
                    merged[-1]["last"] = max(merged[-1]["last"], s["last"])
                else:
                    merged.append(s)
            rows.append(merged)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, batch.schema.field(2).type), batch.column(3)], names=batch.schema.names)


def scan(docs: DataFrame, items: DataFrame, k: int = 10, *, id_col: str = "doc_id", shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """(id, n_words, spans, n_hit, items) of every row of docs.

    spans are the word ranges, half open, that runs of k words of items (or shorter items as a whole) cover; items are the sorted ids of those
    items. Words are lower-cased (A-Z); null and empty texts have none, rows of one id are rows of their own, items without words and an empty
    table of items hit nothing, an empty table of documents gives no rows. Other columns don't matter, whatever their names.
    """
    index = cut(build_index(docs, id_col, shard_bytes=shard_bytes))
    found = find(index, phrases_of(items, k), block).groupBy("shard", "place").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = found.mapInArrow(_union, HITS)
    rows = index.select("shard", F.posexplode(F.arrays_zip("ids", "counts")).alias("place", "row")).select("shard", F.col("place").cast("long").alias("place"), F.col("row.ids").alias(id_col), F.col("row.counts").alias("n_words"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    out = rows.join(found, ["shard", "place"], "left").select(id_col, "n_words", none("spans", "array<struct<first:long,last:long>>"), none("items", "array<string>"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"])
    return out.select(id_col, "n_words", "spans", covered.alias("n_hit"), "items")


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of spans, and what stands between words of one span."""

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, ranges in zip(texts, found):
            data = ("" if t is None else t).encode()
            seen = words(next(slices(pa.array([data.decode()]))), _WORD)
            kept, at = [], 0
            for r in sorted((int(r["first"]), int(r["last"])) for r in (() if ranges is None else ranges)):
                kept.append(data[at : seen.begin[r[0]]])
                at = int(seen.end[r[1] - 1])
            out.append(b"".join([*kept, data[at:]]).decode())
        return pd.Series(out)

    return cut_out(text, spans)
