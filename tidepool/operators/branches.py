"""Branches of a memory: three-way merges, and what recurs often enough to be kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def merge(rows: DataFrame, key: str, content: Column, base: str, source: str, target: str) -> DataFrame:
    """(key, outcome, base, source, target): a three-way merge of rows (key, branch, at, ..), each side's content by its digest.

    Of a branch the last row of a key counts (at, then the digest); a branch
    without rows for a key has what the base has, and a row of null content
    is a deletion. Outcomes:

    - unchanged: neither side differs from the base;
    - taken: the source alone does, the target takes it;
    - kept: the target alone does;
    - agreed: both do, alike;
    - conflict: both do, differently, for somebody to decide.

    One aggregation by key: branches are never joined.
    """
    digest = F.coalesce(F.sha2(content, 256), F.lit("deleted"))
    rows = rows.filter(F.col("branch").isin(base, source, target)).select(key, "branch", F.struct("at", digest.alias("d")).alias("v"))
    last = lambda b: F.max(F.when(F.col("branch") == b, F.col("v")))["d"]
    sides = rows.groupBy(key).agg(last(base).alias("base"), last(source).alias("s"), last(target).alias("t"))
    none = F.coalesce("base", F.lit("deleted"))
    sides = sides.select(key, none.alias("base"), F.coalesce("s", none).alias("source"), F.coalesce("t", none).alias("target"))
    moved = lambda side: F.col(side) != F.col("base")
    outcome = F.when(~moved("source") & ~moved("target"), "unchanged").when(~moved("target"), "taken").when(~moved("source"), "kept").when(F.col("source") == F.col("target"), "agreed").otherwise("conflict")
    return sides.select(key, outcome.alias("outcome"), "base", "source", "target")


#: Hours in which a recurrence fades to 1/e, and the recurrences and the density from which a cluster is kept.
SIGMA_HOURS, LEAST_COUNT, LEAST_DENSITY = 24.0, 2, 1.5


def density(at: Column, likeness: Column, now: Column, sigma_hours: float = SIGMA_HOURS) -> Column:
    """Aggregate: how dense recurrences (seconds, likeness of 0 to 1) are at a moment. Each fades exponentially with its age, so sums over parts of the rows add up, and a stream keeps one number a key. A null likeness adds nothing."""
    age = F.greatest(F.lit(0.0), (now - at).cast("double"))
    return F.sum(F.exp(-age / F.lit(max(1.0, sigma_hours * 3600.0))) * F.greatest(likeness, F.lit(0.0)))


def gated(events: DataFrame, key: str, now: Column, bypass: float, sigma_hours: float = SIGMA_HOURS, least: int = LEAST_COUNT, dense: float = LEAST_DENSITY) -> DataFrame:
    """(key, recurrences, density, bypassed, decision) of events (key, at, likeness, importance).

    Events of an importance of `bypass` or more don't wait; of the others a
    key is consolidated when it recurs `least` times and is dense enough at
    the moment, and held else.
    """
    waits = F.coalesce(F.col("importance") < bypass, F.lit(True))
    out = events.groupBy(key).agg(F.count_if(waits).alias("recurrences"), F.coalesce(density(F.col("at"), F.when(waits, F.col("likeness")), now, sigma_hours), F.lit(0.0)).alias("density"), F.count_if(~waits).alias("bypassed"))
    ready = (F.col("recurrences") >= least) & (F.col("density") >= dense)
    return out.withColumn("decision", F.when(ready, "consolidate").otherwise("hold"))
