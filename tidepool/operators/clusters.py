"""Leader clustering of vectors in blocks: greedy in an order, split over tasks where a block is large, medoids by sums."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut
from . import retrieval

#: Fixed value: cosine distance below which a point belongs to a leader.
RADIUS = 0.20
SPLITS = 16
#: Leaders and points of one product of distances: only memory depends on them.
PART, AT_ONCE = 1024, 512


def _unit(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    length = np.linalg.norm(flat, axis=1, keepdims=True)
    return np.divide(flat, length, out=np.zeros_like(flat), where=length > 0)


class _Leaders:
    """The leaders of a block so far, in parts of PART; distances of AT_ONCE points to a part are one product, so memory holds the leaders and one such product."""

    def __init__(self) -> None:
        self.ids, self.known, self.parts, self.n = [], set(), [], 0

    def add(self, id_: object, unit: np.ndarray) -> None:
        if self.n % PART == 0:
            self.parts.append(np.zeros((PART, len(unit))))
        self.parts[-1][self.n % PART] = unit
        self.ids.append(id_)
        self.known.add(id_)
        self.n += 1

    def nearest(self, units: np.ndarray, since: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(place, distance) of the nearest leader from number `since` on; the first of ties."""
        place, distance = np.zeros(len(units), int), np.full(len(units), np.inf)
        for begin in range(since - since % PART, self.n if since < self.n else 0, PART):
            skip = max(0, since - begin)
            rows = self.parts[begin // PART][skip : self.n - begin].T
            for a in range(0, len(units), AT_ONCE):
                away = np.maximum(0.0, 1.0 - units[a : a + AT_ONCE] @ rows)
                at = away.argmin(axis=1)
                found = away[np.arange(len(at)), at]
                nearer = np.flatnonzero(found < distance[a : a + AT_ONCE])
                place[a + nearer], distance[a + nearer] = begin + skip + at[nearer], found[nearer]
        return place, distance


def _pass(points: DataFrame, key: list[str], radius: float, grow: bool) -> DataFrame:
    """(id, block, leader, distance) of points (key, id, role, vector) in order of role and id: those of role 0 are leaders already, each other joins the nearest leader within the radius or, if grow, becomes one. Without a leader the row has nulls.

    Rows come sorted and batch by batch: memory holds a batch and the leaders
    of one key.
    """
    id_type = points.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders = None, _Leaders()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*[batch.column(k).to_pylist() for k in key]))
            ids, roles, blocks = (batch.column(c).to_pylist() for c in ("id", "role", "block"))
            units, out, at = _unit(batch.column("vector")), [], 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != now:
                    now, leaders = keys[at], _Leaders()
                before = leaders.n
                where, away = leaders.nearest(units[at:end])
                for i in range(at, end):
                    if roles[i] == 0:
                        leaders.add(ids[i], units[i])
                        continue
                    place, distance = where[i - at], away[i - at]
                    if leaders.n > before:  # leaders that this batch brought
                        late, far = leaders.nearest(units[i : i + 1], before)
                        if far[0] < distance:
                            place, distance = late[0], far[0]
                    if ids[i] in leaders.known:  # a leader stays its own, also a zero vector
                        out.append((ids[i], blocks[i], ids[i], 0.0))
                    elif distance < radius:
                        out.append((ids[i], blocks[i], leaders.ids[place], float(distance)))
                    elif grow:
                        leaders.add(ids[i], units[i])
                        out.append((ids[i], blocks[i], ids[i], 0.0))
                    else:
                        out.append((ids[i], blocks[i], None, None))
                at = end
            columns = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (batch.schema.field("id").type, batch.schema.field("block").type, batch.schema.field("id").type, pa.float64()))], names=["id", "block", "leader", "distance"])

    block_type = points.schema["block"].dataType.simpleString()
    dealt = points.repartition(*key).sortWithinPartitions(*key, "role", "id")
    return dealt.mapInArrow(assign, f"id {id_type}, block {block_type}, leader {id_type}, distance double")


def leader_clusters(points: DataFrame, radius: float = RADIUS, splits: int = 1) -> DataFrame:
    """(id, block, leader, distance) of every point (id, block, vector).

    In order of the ids of a block, a point joins the nearest leader within
    the radius (cosine distance) or becomes a leader. With splits over 1 a
    block is dealt over so many tasks: each finds leaders of its own, those
    are thinned in order to leaders apart from each other, and points that
    none of them covers go round again; then all points join the nearest.
    Leaders are at least the radius apart and every point is within it of its
    leader, either way; only the order of choice differs.
    Zero vectors are like nothing and lead themselves. Ids are unique, vectors
    of one length; null vectors are left out.
    """
    rows = points.filter(F.col("vector").isNotNull()).select("id", "block", "vector")
    if splits == 1:
        return _pass(rows.withColumn("role", F.lit(1)), ["block"], radius, True)
    rows = cut(rows.withColumn("split", F.pmod(F.xxhash64("id"), F.lit(splits)).cast("int")))
    left, leaders, parts = rows, [], splits
    while True:
        local = _pass(left.select("id", "block", "vector", (F.col("split") % parts).alias("split"), F.lit(1).alias("role")), ["block", "split"], radius, True)
        found = local.filter("id = leader").select("id")
        thinned = _pass(rows.join(found, "id").select("id", "block", "vector", F.lit(1).alias("role")), ["block"], radius, True) if parts > 1 else local
        leaders.append(cut(rows.join(thinned.filter("id = leader").select("id"), "id").drop("split")))
        everyone = reduce(DataFrame.unionByName, leaders)
        near = cut(_nearest(left, everyone, radius, splits))
        left = cut(left.join(near.filter("leader is null").select("id"), "id"))
        if left.isEmpty():
            return _nearest(rows, everyone, radius, splits)
        parts = max(1, parts // 4)


def _nearest(points: DataFrame, leaders: DataFrame, radius: float, splits: int) -> DataFrame:
    """Points with their nearest leader: the leaders of a block go to each of its splits."""
    everywhere = leaders.select("id", "block", "vector", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), F.lit(0).alias("role"))
    both = everywhere.unionByName(points.select("id", "block", "vector", "split", F.lit(1).alias("role")))
    return _pass(both, ["block", "split"], radius, False)


def medoids(clusters: DataFrame, points: DataFrame) -> DataFrame:
    """(leader, medoid, n): the member of the least summed cosine distance in each cluster, ties to the smallest id. A sum of distances is the number of members minus a unit vector times the sum of all unit vectors, so no pairs are made."""
    unit = F.transform("v", lambda x: F.when(F.col("l") > 0, x / F.col("l")).otherwise(0.0))
    rows = points.select("id", F.transform("vector", lambda x: x.cast("double")).alias("v")).join(clusters.select("id", "leader"), "id")
    rows = cut(rows.withColumn("l", F.sqrt(retrieval.dot(F.col("v"), F.col("v")))).select("id", "leader", unit.alias("u")))
    sums = rows.select("leader", F.posexplode("u").alias("i", "x")).groupBy("leader", "i").agg(F.sum("x").alias("x"))
    total = sums.groupBy("leader").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("t"))
    n = rows.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    away = rows.join(total, "leader").join(n, "leader").withColumn("s", F.round(F.col("n") - retrieval.dot(F.col("u"), F.col("t")), 9))
    return away.groupBy("leader").agg(F.min_by("id", F.struct("s", "id")).alias("medoid"), F.first("n").alias("n"))
