"""Futility detection and recurrence gating as stateful streams, and change application by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import State, ordered_fold

# Evidence of a new and a repeated failure, threshold, share kept after progress, remembered signatures.
NOVEL, REPEATED, THRESHOLD, KEPT, RECENT = 7, 10, 30, 0.25, 8


def fold(evidence: int, recent: list[str], futile: bool, failed: bool, signature: str) -> tuple[int, list[str], bool, str]:
    """One step: (evidence, recent signatures, futile, verdict)."""
    if not failed:
        return int(evidence * KEPT), recent, False, "Continue"
    evidence += REPEATED if signature in recent else NOVEL
    recent = [*[s for s in recent if s != signature], signature][-RECENT:]
    if evidence < THRESHOLD:
        return evidence, recent, futile, "Continue"
    return evidence, recent, True, "StillFutile" if futile else "Futile"


SCHEMA = "task string, seq long, evidence int, verdict string"


def _step(state: State | None, row: tuple) -> tuple[State, tuple]:
    """One event (task, seq, ts, failed, signature) of a task."""
    task, seq, _, failed, signature = row
    evidence, recent, futile, verdict = fold(*(state or (0, [], False)), failed, signature)
    return (evidence, recent, futile), (task, seq, evidence, verdict)


def futility_batch(events: DataFrame) -> DataFrame:
    """Verdicts over a table (task, seq, ts, failed, signature), in order of ts and seq: a sorted stream of rows with one state, so a task's history is never held."""
    return ordered_fold(events.select("task", "seq", "ts", "failed", "signature"), "task", ["ts", "seq"], _step, SCHEMA)


def futility_stream(events: DataFrame) -> DataFrame:
    """The same verdicts over a stream; state is a number, a flag and at most RECENT signatures a task."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.get if state.exists else None, []
        rows = pd.concat(list(batches))  # a micro-batch's rows of one task
        for row in rows[["task", "seq", "ts", "failed", "signature"]].sort_values(["ts", "seq"]).itertuples(index=False, name=None):
            now, values = _step(now and (now[0], list(now[1]), now[2]), row)
            out.append(values)
        state.update(now)
        yield pd.DataFrame(out, columns=["task", "seq", "evidence", "verdict"])

    return events.groupBy("task").applyInPandasWithState(
        step, SCHEMA, "evidence int, recent array<string>, futile boolean", "append", GroupStateTimeout.NoTimeout
    )


def recurrence(events: DataFrame, least: int = 2, window: str = "1 day") -> DataFrame:
    """(signature, window start, n) of signatures seen at least so often in a window; late rows beyond a day are dropped when streaming."""
    seen = events.withWatermark("ts", "1 day").groupBy(F.window("ts", window), "signature").agg(F.count(F.lit(1)).alias("n"))
    return seen.filter(F.col("n") >= least).select("signature", F.col("window.start").alias("start"), "n")


def apply_changes(batch: DataFrame, table: DataFrame, key: str, seq: str) -> DataFrame:
    """A table after a batch of changes (the table's columns, seq and op): the highest seq of a key wins, deletes go. For use in foreachBatch, where the result is written as a new version."""
    columns = [c for c in table.columns if c != seq]
    both = table.withColumn("op", F.lit("keep")).unionByName(batch.select(*table.columns, "op"))
    last = both.groupBy(key).agg(F.max(F.struct(seq, "op", *[c for c in columns if c != key])).alias("r"))
    return last.filter("r.op <> 'delete'").select(key, *[F.col(f"r.{c}").alias(c) for c in table.columns if c != key])
