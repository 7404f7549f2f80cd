"""Leases as a stream: one value of state a resource, and a timer that ends an expired lease."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import CLAIMED, claim


class Leases(StatefulProcessor):
    """Claims of a micro-batch in order, against the lease that stands. State is the holder and the end; it goes with the lease."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "holder long, held_until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state, out = self.lease.get() if self.lease.exists() else None, []
        claims = pd.concat(list(rows))[["resource", "holder", "at", "ttl", "release"]].sort_values(["at", "holder", "release", "ttl"])  # a micro-batch's claims on one resource
        before = state
        for row in claims.itertuples(index=False, name=None):
            state, values = claim(state, row)
            out.append(values)
        if before is not None and state != before:
            self.handle.deleteTimer(int(before[1]) * 1000)
        if state is None:
            self.lease.clear()
        else:
            self.lease.update((int(state[0]), int(state[1])))
            self.handle.registerTimer(int(state[1]) * 1000)
        yield pd.DataFrame(out, columns=["resource", "holder", "at", "outcome", "held_by", "held_until"]).astype({"held_by": "Int64", "held_until": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.lease.clear()
        return iter([])

    def close(self) -> None:
        pass


def lease_stream(claims: DataFrame, late: str = "1 day") -> DataFrame:
    """Outcomes of a stream of claims (resource, holder, at, ttl, release, ts), as operators.folds.leases gives them over a table.

    ts is `at` as a timestamp. A claim that comes later than the watermark
    allows finds no expired lease any more, which is as if it had expired.
    Needs the RocksDB state store. Claims are ordered within a micro-batch;
    those of earlier ones came first.
    """
    return claims.withWatermark("ts", late).groupBy("resource").transformWithStateInPandas(Leases(), CLAIMED, "Append", "EventTime")
