"""Tables as logs: latest version wins, counters add up, rows move between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the order columns; one aggregation with partial results, no sort of a key's history."""
    others = [c for c in log.columns if c != key]
    last = F.max(F.struct(*order, *[c for c in others if c not in order])).alias("last")
    return log.groupBy(key).agg(last).select(key, *[F.col(f"last.{c}").alias(c) for c in others])


def failure_upsert(log: DataFrame, signature: str, at: str) -> DataFrame:
    """Failures by signature: occurrences, first and last time."""
    return log.groupBy(signature).agg(F.count(F.lit(1)).alias("occurrences"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def split(df: DataFrame, archived: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, archived) by a condition; a null condition keeps."""
    gone = F.coalesce(archived, F.lit(False))
    return df.filter(~gone), df.filter(gone)


def moving_average(values: Column, start: float, rate: float = 0.2) -> Column:
    """Exponential moving average over an array in its order."""
    return F.aggregate(values, F.lit(start), lambda acc, x: acc * F.lit(1 - rate) + x * F.lit(rate))
