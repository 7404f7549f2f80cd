"""Row patterns over sessions: a failure, what was tried, and the success it led to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Fixed value: how many events after a failure its recovery may take.
AHEAD = 10


def recoveries(log: DataFrame) -> DataFrame:
    """(session_id, failed_at, recovered_at, steps): recovery trajectories of sessions.

    log has (session_id, seq, kind, step): kind is failure, attempt, success or
    other, step names what an attempt does; seq orders a session and is unique
    in it. A failure's trajectory ends at the first success after its first
    attempt within AHEAD events, and its steps are the attempts up to there.
    Trajectories don't overlap: a failure within one already taken is part of
    it; one that starts where another ends is a trajectory of its own.

    A window numbers the events and gives each failure the few that follow. Of
    the trajectories that may overlap, those chained by less than AHEAD events,
    the choice is one fold from the first on.
    """
    by = W.partitionBy("session_id").orderBy("seq")
    numbered = log.select("session_id", "seq", "kind", "step", F.row_number().over(by).alias("place"))
    following = F.collect_list(F.struct("place", "kind", "step", "seq")).over(by.rowsBetween(1, AHEAD))
    failures = numbered.withColumn("next", following).filter("kind = 'failure'")
    first_try = F.array_min(F.transform(F.filter("next", lambda e: e["kind"] == "attempt"), lambda e: e["place"]))
    end = F.array_min(F.transform(F.filter("next", lambda e: (e["kind"] == "success") & (e["place"] > F.col("tried"))), lambda e: F.struct(e["place"].alias("place"), e["seq"].alias("seq"))))
    found = failures.withColumn("tried", first_try).withColumn("end", end).filter("end is not null")
    steps = F.transform(F.filter("next", lambda e: (e["kind"] == "attempt") & (e["place"] < F.col("end.place"))), lambda e: e["step"])
    found = found.select("session_id", "place", F.col("seq").alias("failed_at"), F.col("end.place").alias("until"), F.col("end.seq").alias("recovered_at"), steps.alias("steps"))
    # A trajectory that starts where or after all earlier ones end starts a chain.
    before = W.partitionBy("session_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    opens = F.when(F.coalesce(F.max("until").over(before), F.lit(0)) <= F.col("place"), 1).otherwise(0)
    chained = found.withColumn("opens", opens).withColumn("chain", F.sum("opens").over(W.partitionBy("session_id").orderBy("place")))
    row = F.struct("place", "until", "failed_at", "recovered_at", "steps")
    chains = chained.groupBy("session_id", "chain").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return chains.select("session_id", F.explode(_apart("rows")).alias("t")).select("session_id", "t.failed_at", "t.recovered_at", "t.steps")


def _apart(rows: str) -> Column:
    """Of ordered ranges those that start where or after the last one taken ends."""
    taken = F.aggregate(rows, F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts")), lambda a, r: F.when(r["place"] >= a["end"], F.struct(r["until"].alias("end"), F.concat(a["starts"], F.array(r["place"])).alias("starts"))).otherwise(a))
    return F.filter(rows, lambda r: F.array_contains(taken["starts"], r["place"]))
