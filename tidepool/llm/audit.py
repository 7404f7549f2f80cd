"""Interaction of text filters: what each removes in every order, what others remove already, and what good and bad documents cost.

The five filters fail a document of under 100 words (A), of few distinct words
(B), of many capitals (C), with markup symbols (D), or whose text a smaller id
has too (E). A to D are read from Arrow buffers in one scan of the texts; what
comes out is one small row a document. E and all counts are aggregations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .words import Hasher, Slice, Words, slices, words

FILTERS = "ABCDE"
# Least words, hundredths of distinct words, hundredths of capitals, symbols.
LEAST_WORDS, DISTINCT, CAPITALS, SYMBOLS = 100, 80, 10, "#$%&*|"

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_BEGINS = np.ones(256, bool)  # bytes that begin a code point
_BEGINS[0x80:0xC0] = False


def _sums(flags: np.ndarray, part: Slice) -> np.ndarray:
    """How many flagged bytes each document has, by prefix sums."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[part.ends] - total[part.starts]


def distinct_words(part: Slice, found: Words, hash_bits: int = 40) -> np.ndarray:
    """How many distinct words each document has: its sorted word hashes, where neighbours of one hash are compared by their bytes.

    Hashes are cut to hash_bits, so that the document and the hash sort as one number. Runs of one hash with different words are counted word by word.
    """
    counts = found.counts
    if not len(found.begin):
        return counts
    hashes = Hasher(part.data).spans(found.begin, found.end) >> np.uint64(64 - hash_bits)
    key = (found.owner().astype(np.uint64) << np.uint64(hash_bits)) | hashes
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    one, two = order[same], order[same + 1]
    size = found.end - found.begin
    alike = size[one] == size[two]
    padded = np.concatenate([part.data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    going, at = np.flatnonzero(alike), 0
    while len(going):  # eight bytes a round, of the pairs that go on
        left = size[one[going]] - at
        mask = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (8 * np.clip(left, 0, 7)).astype(np.uint64)) - np.uint64(1))
        differ = (eights[found.begin[one[going]] + at] ^ eights[found.begin[two[going]] + at]) & mask != 0
        alike[going[differ]] = False
        going, at = going[~differ & (left > 8)], at + 8
    repeated = np.zeros(len(key), bool)
    repeated[same + 1] = True
    repeats = np.bincount(found.owner()[order[repeated]], minlength=len(counts))
    for value in np.unique(key[same[~alike]]):
        run = order[np.searchsorted(key, value) : np.searchsorted(key, value, side="right")]
        repeats[int(value >> np.uint64(hash_bits))] -= len({part.data[found.begin[w] : found.end[w]].tobytes() for w in run}) - 1
    return counts - repeats


def text_failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str]) -> DataFrame:
    """(id, carried columns, failed, digest): failed has a bit for each of A to D, A the lowest; digest is the SHA-256 of the text. A null text is empty."""
    kept = docs.select(F.col(id_col), *carry, F.col(text_col).alias("__text"))
    schema = T.StructType([f for f in kept.schema if f.name != "__text"]).add("failed", "integer").add("digest", "binary")

    def failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, digests = [np.zeros(0, np.int32)], []
            for part in slices(batch.column(batch.num_columns - 1), 1 << 18):
                found = words(part)
                n, chars = found.counts, _sums(_BEGINS[part.data], part)
                bits = (n < LEAST_WORDS) + 2 * (100 * distinct_words(part, found) < DISTINCT * n)
                bits = bits + 4 * (100 * _sums(_CAPITAL[part.data], part) > CAPITALS * chars) + 8 * (_sums(_SYMBOL[part.data], part) > 0)
                failed.append(bits.astype(np.int32))
                data = memoryview(np.ascontiguousarray(part.data))
                digests += [hashlib.sha256(data[a:b]).digest() for a, b in zip(part.starts, part.ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(failed)), pa.array(digests, pa.binary())], names=schema.names)

    return kept.mapInArrow(failures, schema)


def outcomes(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, failed, n, good, toxic): documents by part and by the set of filters that they fail, all five, and how many of them are labelled good and toxic.

    A document fails E if a smaller id has its text, wherever. A null id is
    larger than all others. Rows of one id and text don't count for each
    other. A null part is an empty text. Null labels count as none, of
    repeated labels the larger counts; an empty table gives no rows.
    """
    read = text_failures(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text_in"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")), id_col="__id", text_col="__text_in", carry=["part"])
    rows = read.groupBy("__id", "part", "failed", "digest").agg(F.count(F.lit(1)).alias("n"))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    none = rows.filter(F.col("__id").isNull()).withColumns({c: F.lit(None).cast(known.schema[c].dataType) for c in ("quality", "toxic")})
    rows = rows.filter(F.col("__id").isNotNull()).join(known, "__id", "left").unionByName(none)
    rows = rows.select("__id", "part", "failed", "digest", "n", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"))
    # Rows of the smallest id of a text pass E. Texts shrink to a few rows each before a text's rows meet.
    first = F.struct(F.col("__id").isNull(), F.col("__id"))
    texts = rows.groupBy("digest", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct(first.alias("id"), "n")).alias("lead"))
    leads = texts.groupBy("digest").agg(F.min("lead.id").alias("lead_id"))
    marked = texts.join(leads, "digest").withColumn("passes", F.when(F.col("lead.id") == F.col("lead_id"), F.col("lead.n")).otherwise(0))
    state = F.explode(F.array(F.struct(F.col("failed"), F.col("passes").alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("passes")).alias("n"))))
    counted = marked.select("part", "good", "toxic", state.alias("s")).select("part", "good", "toxic", "s.failed", "s.n")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return counted.groupBy("part", "failed").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic")).filter("n > 0")


def interactions(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from outcomes(): all orders of all parts, zeros included.

    A part has one state for each set of failed filters at most, 32; they
    become one array, and every order reads it.
    """
    states = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("states"))
    orders = [F.lit("".join(order)) for order in permutations(letters)]
    steps = states.select("part", "states", F.explode(F.array(*orders)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    bit = lambda letter: F.pow(F.lit(2), F.instr(F.lit(letters), letter) - 1).cast("int")
    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda a, i: F.when(i == 0, a).otherwise(a + bit(F.substr("filter_order", i, F.lit(1)))))
    steps = steps.select("*", bit(F.substr("filter_order", F.col("step"), F.lit(1))).alias("own"), before.alias("before"))
    own, earlier = F.col("own"), F.col("before")
    fails = lambda s: s["failed"].bitwiseAND(own) > 0
    gone = lambda s: s["failed"].bitwiseAND(earlier) > 0
    total = lambda when, what: F.aggregate("states", F.lit(0).cast("long"), lambda a, s: a + F.when(when(s), what(s)).otherwise(0))
    n = lambda s: s["n"]
    here = lambda s: fails(s) & ~gone(s)
    all_orders = len(list(permutations(letters)))
    share = lambda s: s["n"] * (F.lit(all_orders) / F.bit_count(s["failed"])).cast("long")  # noqa: E731  of a set of k filters each comes first equally often
    return steps.select(
        "part", "filter_order", "step",
        total(lambda s: ~fails(s) & ~gone(s), n).alias("kept"), total(here, n).alias("removed"), total(lambda s: fails(s) & gone(s), n).alias("redundant"),
        total(lambda s: s["failed"] == own, n).alias("unique_fails"), total(here, lambda s: s["good"]).alias("good_lost"), total(here, lambda s: s["toxic"]).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of all documents."""
    return interactions(outcomes(docs, labels))
