"""Ordered folds of a key's history: composable maps for numbers, sorted streams for the rest, so that no key's history is held at once.

A clamped linear map w -> min(high, max(low, slope w + shift)) with a positive
slope composes with another to one of the same kind. So a history becomes one
map by a tree: ranges of (key, order) are composed apart, also where one key
spans many, and a key's few maps are joined in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import dealt

#: Steps of reinforcement and depression, and the bounds of an edge's weight.
REINFORCE, DEPRESS, LEAST, MOST = 0.15, 0.20, 0.05, 1.0


def _composed(run: np.ndarray, maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, map) of each run of equal numbers, its maps composed in order: neighbours are composed pair by pair until each run is one map."""
    while True:
        heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        if len(heads) == len(run):
            return run, maps
        place = np.arange(len(run)) - np.repeat(heads, np.diff(np.r_[heads, len(run)]))
        first = np.flatnonzero(place % 2 == 0)
        has = (first + 1 < len(run)) & (run[np.minimum(first + 1, len(run) - 1)] == run[first])
        out, then = maps[first].copy(), maps[np.minimum(first + 1, len(run) - 1)]
        slope, shift, low, high = then.T
        within = lambda w: np.minimum(high, np.maximum(low, slope * w + shift))  # noqa: B023, E731
        merged = np.column_stack([slope * out[:, 0], slope * out[:, 1] + shift, within(out[:, 2]), within(out[:, 3])])
        out[has] = merged[has]
        run, maps = run[first], out


def composed(log: DataFrame, keys: list[str], order: list[str], slope: Column, shift: Column, low: Column, high: Column) -> DataFrame:
    """(keys, slope, shift, low, high): each key's maps composed in the order of the columns, which must tell its rows apart.

    Rows are dealt by range of (keys, order), so a key of any share of the
    rows spreads over many tasks; each gives one map a key, and those of a key
    are as many as it has ranges.
    """
    names = ["slope", "shift", "low", "high"]
    rows = log.select(*keys, *order, *[c.cast("double").alias(n) for c, n in zip((slope, shift, low, high), names)])
    # Tied values of a range column stay in one range, so the whole order is part of it.
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType([dealt.schema[k] for k in keys] + [T.StructField(f"first_{o}", dealt.schema[o].dataType) for o in order] + [T.StructField(n, T.DoubleType()) for n in names])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = np.zeros(batch.num_rows, bool)
            changed[0] = True
            for k in keys:
                column = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                changed[1:] |= column[1:] != column[:-1]
            run = np.cumsum(changed) - 1
            _, done = _composed(run, np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]))
            heads = batch.take(pa.array(np.flatnonzero(changed)))
            yield pa.RecordBatch.from_arrays([*[heads.column(c) for c in [*keys, *order]], *[pa.array(done[:, i]) for i in range(4)]], names=schema.names)

    parts = dealt.mapInArrow(maps, schema)
    # One map a key and batch of a range: few even for a key of a third of all rows.
    step = F.struct(*[f"first_{o}" for o in order], *names)
    inside = lambda m, w: F.least(m["high"], F.greatest(m["low"], m["slope"] * w + m["shift"]))
    start = F.struct(F.lit(1.0).alias("slope"), F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    join = lambda f, g: F.struct((g["slope"] * f["slope"]).alias("slope"), (g["slope"] * f["shift"] + g["shift"]).alias("shift"), inside(g, f["low"]).alias("low"), inside(g, f["high"]).alias("high"))
    whole = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(step)).alias("maps")).withColumn("map", F.aggregate("maps", start, join))
    return whole.select(*keys, *[F.col(f"map.{n}").alias(n) for n in names])


def apply(start: Column) -> Column:
    """A composed map (its four columns) applied to a start value."""
    return F.least("high", F.greatest(F.col("low"), F.col("slope") * start + F.col("shift")))


def edge_weights(feedback: DataFrame, defaults: Column) -> DataFrame:
    """(src, dst, kind, weight, reinforcements, depressions, last) after feedback (src, dst, kind, at, seq, positive, score) in order of at and seq.

    Positive feedback moves the weight a step towards one, any other a step
    towards zero, each scaled by its score (none or less than nothing: 1) and
    kept within bounds. defaults is the weight of an edge without history, by
    its kind. Short histories end on few decimals, where the last bit decides
    how a weight is rounded; so steps are taken one after another, not as
    composed maps. An edge's rows are one chain, read by one task batch by
    batch: memory holds one batch and one weight, whatever the history.
    """
    keys = ["src", "dst", "kind"]
    score = F.when(F.coalesce("score", F.lit(0.0)) <= 0, 1.0).otherwise(F.least("score", F.lit(1.0)))
    rows = feedback.select(*keys, "at", "seq", F.coalesce("positive", F.lit(False)).alias("positive"), score.cast("double").alias("score"), defaults.cast("double").alias("start"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "at", "seq")
    fields = [dealt.schema[k] for k in keys] + [T.StructField("weight", T.DoubleType()), T.StructField("reinforcements", T.LongType()), T.StructField("depressions", T.LongType()), T.StructField("last", dealt.schema["at"].dataType)]
    schema = T.StructType(fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, w, ups, downs, last = None, 0.0, 0, 0, None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("positive", "score", "start", "at")]
            for key, good, s, start, at in zip(zip(*[batch.column(k).to_pylist() for k in keys]), *columns):
                if key != now:
                    if now is not None:
                        done.append((*now, w, ups, downs, last))
                    now, w, ups, downs = key, start, 0, 0
                w = w + REINFORCE * s * (1 - w) if good else w - DEPRESS * s * w
                w = max(LEAST, min(MOST, w))
                ups, downs, last = ups + good, downs + (not good), at
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema=to_arrow_schema(schema))
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now, w, ups, downs, last)))], schema=to_arrow_schema(schema))

    return dealt.mapInArrow(walk, schema)


def moving_average(log: DataFrame, key: str, order: list[str], value: Column, start: float, rate: float = 0.2) -> DataFrame:
    """(key, average): the exponential moving average of each key's values in order."""
    no = float("inf")
    return composed(log, [key], order, F.lit(1 - rate), value * F.lit(rate), F.lit(-no), F.lit(no)).select(key, apply(F.lit(start)).alias("average"))


State = tuple
Step = Callable[[State | None, tuple], tuple[State | None, tuple]]


def ordered_fold(log: DataFrame, key: str, order: list[str], step: Step, out: str) -> DataFrame:
    """One row out for each row of the log, by a step (state, row) -> (state, values) that goes through each key's rows in order; a key starts from no state.

    Rows are dealt by key and sorted, and read batch by batch: memory holds
    one batch and one state, whatever a key's history, and the tasks are as
    many as the rows need. log has the key first. A key's rows are one chain,
    so they are read by one task.
    """
    columns = [key, *[c for c in log.columns if c != key]]
    schema = T._parse_datatype_string(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                if row[0] != now:
                    now, state = row[0], None
                state, values = step(state, row)
                rows.append(values)
            yield pd.DataFrame(rows, columns=schema.names)

    return dealt(log.select(*columns), key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


# Leases


def claim(state: State | None, row: tuple) -> tuple[State | None, tuple]:
    """One claim (resource, holder, at, ttl, release) on a lease (holder, expires): it is free when there is none, when it has expired, or for its holder; a denied claim changes nothing. A release ends the holder's own lease."""
    resource, holder, at, ttl, release = row
    if release:
        mine = state is not None and state[0] == holder
        return (None if mine else state), (resource, holder, at, "released" if mine else "not held", None, None)
    if state is None or state[1] <= at or state[0] == holder:
        return (holder, at + ttl), (resource, holder, at, "granted", holder, at + ttl)
    return state, (resource, holder, at, "denied", state[0], state[1])


CLAIMED = "resource long, holder long, at long, outcome string, held_by long, held_until long"


def leases(claims: DataFrame) -> DataFrame:
    """Outcomes of claims (resource, holder, at, ttl, release), in order of at, holder, release and ttl: granted, denied, released or not held, with the holder and the end of the lease that stands."""
    return ordered_fold(claims.select("resource", "holder", "at", "ttl", "release"), "resource", ["at", "holder", "release", "ttl"], claim, CLAIMED)
