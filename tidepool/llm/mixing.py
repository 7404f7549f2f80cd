"""Mixing sources to target weights by systematic sampling, all in native expressions.

Every document of a source has the same number of expected copies, its
source's target over its source's size. The documents of a source are put in
one order, expected copies are summed along it, one random offset is added,
and a document is taken once for each integer that the sum crosses while
passing it. So each taken count is the expected one rounded up or down, and
because the order goes by size class, the taken words stay near the target.

The order is (size class, salt, size, id). Salts split hot sources and groups
of equal sizes: the prefix sums are made of one total per (source, class,
salt) and a row number within each, so no task sees a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WORD = r"[^\x20\x09-\x0D]+"
ROWS_A_SALT = 1_000_000
LEAST_SALTS = 64


def words_in(text: Column | str) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _unit(key: Column) -> Column:
    """A number from 0 to 1 that depends on key only."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float, source_col: str, size_col: str) -> DataFrame:
    """One row per source: __source, __total, __target.

    Sources in code point order, null last, get the weights in turn, again and
    again. They divide share x all sizes by weight; no target is above
    cap x the source's own size, and what is over goes to the others by weight
    until none is above. With the sources sorted by cap over weight, the first
    k of them are at their cap, and the level (words per weight) of the rest
    follows from two running sums, so no repeated passes are needed. The
    windows hold one row per source.
    """
    totals = sized.groupBy(F.col(source_col).alias("__source")).agg(F.sum(size_col).alias("__total"))
    place = F.row_number().over(W.orderBy(F.col("__source").asc_nulls_last())) - 1
    choice = F.array(*[F.lit(float(w)) for w in weights])
    by_ratio = W.orderBy("__ratio", F.col("__source").asc_nulls_last())
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = (
        totals.withColumn("__weight", F.get(choice, (place % len(weights)).cast("int")))
        .withColumn("__cap", F.col("__total") * F.lit(float(cap)))
        .withColumn("__ratio", F.col("__cap") / F.col("__weight"))
        .withColumn("__budget", F.sum("__total").over(everything) * F.lit(float(share)))
        .withColumn("__below", F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__rest", F.sum("__weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("__at", F.row_number().over(by_ratio))
        .withColumn("__own_level", (F.col("__budget") - F.col("__below")) / F.col("__rest"))
    )
    level = F.min_by("__own_level", F.when(F.col("__own_level") <= F.col("__ratio"), F.col("__at"))).over(everything)
    return ranked.select(
        "__source", "__total", F.coalesce(F.least("__cap", F.col("__weight") * level), F.col("__cap")).alias("__target")
    )


def mix_sources(
    docs: DataFrame,
    *,
    size_col: str = "size",
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """Add source_size, target and copies (how often the mix takes the row) to docs.

    docs is read more than once, so pass a frame that is cheap to read again.
    Sizes are non-negative; null sizes count as 0. A null source is a source
    of its own, the last. A source without words has target 0 and no copies.
    Repeated rows are rows of their own; rows alike in source, size and id are
    interchangeable. Null ids are ordered first. An empty table stays empty.
    Columns of docs named source_size, target or copies are replaced.
    Runs agree: offsets and salts are hashes of seed, source and id.
    """
    keep = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    sized = docs.select(
        *[docs[c] for c in keep],
        F.coalesce(docs[size_col].cast("long"), F.lit(0).cast("long")).alias("__size"),
    )
    targets = source_targets(sized, weights, share, cap, source_col, "__size")
    salts = max(LEAST_SALTS, sized.count() // ROWS_A_SALT)
    salt = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("long")
    dealt = sized.withColumn("__class", F.length(F.bin("__size"))).withColumn("__salt", salt % F.lit(salts))
    group = [F.col(source_col), F.col("__class"), F.col("__salt")]
    blocks = dealt.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows"))
    # Running totals in two steps: over the classes of a source, then over the salts of a class.
    classes = blocks.groupBy(F.col(source_col), F.col("__class")).agg(F.sum("__rows").alias("__rows"))
    class_base = F.coalesce(
        F.sum("__rows").over(W.partitionBy(source_col).orderBy("__class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    salt_base = F.coalesce(
        F.sum("__rows").over(W.partitionBy(source_col, "__class").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0),
    )
    class_bases = classes.select(F.col(source_col).alias("__s"), F.col("__class").alias("__c"), class_base.alias("__class_base"))
    bases = blocks.select(
        F.col(source_col).alias("__s"), F.col("__class").alias("__c"), F.col("__salt").alias("__k"), salt_base.alias("__salt_base")
    )
    bases = (
        bases.alias("b")
        .join(class_bases.alias("c"), F.col("b.__s").eqNullSafe(F.col("c.__s")) & (F.col("b.__c") == F.col("c.__c")))
        .join(targets.alias("t"), F.col("b.__s").eqNullSafe(F.col("t.__source")))
        .select(
            F.col("b.__s").alias("__s"),
            F.col("b.__c").alias("__c"),
            F.col("b.__k").alias("__k"),
            (F.col("__class_base") + F.col("__salt_base")).alias("__base"),
            "__total",
            "__target",
        )
    )
    within = W.partitionBy(source_col, "__class", "__salt").orderBy("__size", F.col(id_col).asc_nulls_first())
    placed = dealt.withColumn("__row", F.row_number().over(within))
    placed = placed.join(
        bases,
        F.col(source_col).eqNullSafe(F.col("__s")) & (F.col("__class") == F.col("__c")) & (F.col("__salt") == F.col("__k")),
    )
    rate = F.when(F.col("__total") > 0, F.col("__target") / F.col("__total")).otherwise(F.lit(0.0))
    offset = _unit(F.concat_ws(":", F.lit(seed), F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("null"))))
    rank = F.col("__base") + F.col("__row")
    crossed = F.floor(F.col("__rate") * rank + F.col("__offset")) - F.floor(F.col("__rate") * (rank - 1) + F.col("__offset"))
    return (
        placed.withColumn("__rate", rate)
        .withColumn("__offset", offset)
        .select(
            *keep,
            F.col("__total").alias("source_size"),
            F.col("__target").alias("target"),
            F.least(crossed, F.lit(int(-(-cap // 1)))).cast("long").alias("copies"),
        )
    )


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say, without the columns that mix_sources added."""
    rows = mixed.filter("copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, copies)")))
    return rows.drop("__copy", "copies", "source_size", "target")
