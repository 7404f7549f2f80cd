"""Session analytics over the event log: salience, digests, sequences, trajectories, replay rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# What each event type adds to a session's salience, and the caps of the size and count terms.
SALIENCE = {"ErrorObserved": 0.35, "ToolResultFailed": 0.30, "ToolResultReceived": 0.15, "ToolInvoked": 0.10, "TaskCompleted": 0.4, "SessionEnded": 0.2}
SIZE_PER, SIZE_CAP, COUNT_PER, COUNT_CAP = 5000.0, 0.25, 10.0, 0.2


def salience(events: DataFrame, key: str = "session_id", kind: str = "event_type", size: str = "props") -> DataFrame:
    """(key, n_events, salience): weights by type, plus capped terms for payload size and number, clamped to 0..1."""
    weight = F.lit(0.0)
    for name, w in SALIENCE.items():
        weight = F.when(F.col(kind) == name, F.lit(w)).otherwise(weight)
    total = F.sum(weight.cast("decimal(10,4)")).cast("double")
    sizes = F.sum(F.length(F.coalesce(F.col(size), F.lit("")))) / F.lit(SIZE_PER)
    n = F.count(F.lit(1))
    score = total + F.least(F.lit(SIZE_CAP), sizes) + F.least(F.lit(COUNT_CAP), n / F.lit(COUNT_PER))
    return events.groupBy(key).agg(n.alias("n_events"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("salience"))


def sequence_support(events: DataFrame, lengths: tuple[int, ...] = (2, 3), key: str = "session_id", kind: str = "event_type") -> DataFrame:
    """(ngram, support, occurrences) of runs of event types: support counts the sessions that have one.

    Runs come from lag over (session, ts, seq), so a session's events are
    sorted and never collected.
    """
    w = W.partitionBy(key).orderBy("ts", "seq")
    grams = []
    for n in lengths:
        steps = [F.lag(kind, n - 1 - i).over(w) if i < n - 1 else F.col(kind) for i in range(n)]
        grams.append(events.select(key, F.when(steps[0].isNotNull(), F.concat_ws(">", *steps)).alias("ngram")).filter("ngram is not null"))
    union = grams[0]
    for g in grams[1:]:
        union = union.unionByName(g)
    per = union.groupBy("ngram", key).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("ngram").agg(F.count(F.lit(1)).alias("support"), F.sum("n").alias("occurrences"))


def fixes(events: DataFrame, key: str = "session_id") -> DataFrame:
    """(session, error seq, fix seq): the first completed task after each error of a session, if no other error lies between."""
    w = W.partitionBy(key).orderBy("ts", "seq")
    marks = events.filter(F.col("event_type").isin("ErrorObserved", "TaskCompleted"))
    marks = marks.withColumn("next_type", F.lead("event_type").over(w)).withColumn("next_seq", F.lead("seq").over(w))
    found = marks.filter((F.col("event_type") == "ErrorObserved") & (F.col("next_type") == "TaskCompleted"))
    return found.select(key, F.col("seq").alias("error_seq"), F.col("next_seq").alias("fix_seq"))


def idle_sessions(events: DataFrame, gap_seconds: int, key: str = "session_id") -> DataFrame:
    """(key, part, n, first, last): an event log cut where nothing happened for gap_seconds."""
    w = W.partitionBy(key).orderBy("ts", "seq")
    at = F.unix_timestamp("ts")
    new = F.when(at - F.lag(at).over(w) > gap_seconds, 1).otherwise(0)
    parts = events.withColumn("__new", new).withColumn("part", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return parts.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def replay_reward(ok: Column, steps: Column, salience_: Column) -> Column:
    return F.lit(0.7) * ok / F.greatest(steps, F.lit(1)) + F.lit(0.3) * salience_


def stratified(df: DataFrame, stratum: str, quotas: dict[str, int], priority: str, tie: str) -> DataFrame:
    """The rows of highest priority in each stratum, as many as its quota says."""
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(stratum) == name, F.lit(n)).otherwise(quota)
    place = F.row_number().over(W.partitionBy(stratum).orderBy(F.desc(priority), tie))
    return df.withColumn("place", place).filter(F.col("place") <= quota)


def within_budget(df: DataFrame, group: str, order: list[Column], text: str, budget: int) -> DataFrame:
    """Rows of each group in order while their estimated tokens (a quarter of the characters, rounded up) fit the budget."""
    cost = F.ceil(F.length(text) / F.lit(4)).cast("long")
    running = F.sum("cost").over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("cost", cost).withColumn("running", running).filter(F.col("running") <= budget)
