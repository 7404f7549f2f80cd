"""Best activation paths: products of edge weights relaxed hop by hop, with parents, and paths read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..runtime import cut, few


def best_paths(edges: DataFrame, source: str, depth: int) -> DataFrame:
    """(node, hops, energy, parent, kind): every improvement of a node's best product of weights from the source, by rounds.

    edges are (src, dst, kind, weight) with weights of 0 to 1. A round relaxes
    the edges of those nodes alone that improved in the round before. A later
    row of a node has a larger energy, so the last one is its best; ties go to
    fewer hops, then to the smallest parent and kind.
    """
    edges = cut(edges.select("src", "dst", "kind", "weight"))
    spark = edges.sparkSession
    start = spark.createDataFrame([(source, 0, 1.0, None, None)], "node string, hops int, energy double, parent string, kind string")
    rounds, best = [cut(start)], start.select("node", "energy")
    for hop in range(1, depth + 1):
        front = rounds[-1].select(F.col("node").alias("src"), "energy")
        offers = edges.join(few(front), "src").select(F.col("dst").alias("node"), (F.col("energy") * F.col("weight")).alias("energy"), F.col("src").alias("parent"), "kind").filter("energy > 0")
        top = offers.groupBy("node").agg(F.min(F.struct((-F.col("energy")).alias("e"), "parent", "kind")).alias("b"))
        top = top.select("node", F.lit(hop).alias("hops"), (-F.col("b.e")).alias("energy"), "b.parent", "b.kind")
        known = best.withColumnRenamed("energy", "had")
        better = cut(top.join(known, "node", "left").filter("had is null or energy > had").drop("had"))
        if better.isEmpty():
            break
        rounds.append(better)
        best = cut(best.unionByName(better.select("node", "energy")).groupBy("node").agg(F.max("energy").alias("energy")))
    return cut(reduce(DataFrame.unionByName, rounds))


def read_back(steps: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(target, energy, hops, path): the best path of each target (node) as an array of (node, kind) after the source. steps is what best_paths gives; targets that aren't reached give no row."""
    last = steps.groupBy("node").agg(F.max(F.struct("energy", "hops", "parent", "kind")).alias("l")).select("node", "l.*")
    step = lambda node, kind: F.struct(F.col(node).alias("node"), F.col(kind).alias("kind"))
    walk = targets.select("node").distinct().join(last, "node")
    walk = cut(walk.select(F.col("node").alias("target"), "energy", F.col("hops").alias("total"), "hops", F.col("parent").alias("at"), F.when(F.col("hops") > 0, F.array(step("node", "kind"))).otherwise(F.array().cast("array<struct<node:string,kind:string>>")).alias("path")))
    for _ in range(depth):
        open_ = walk.filter("at is not null")
        # The parent's best at the time: its last improvement in an earlier round.
        before = open_.join(steps.select(F.col("node").alias("at"), F.col("hops").alias("then"), "parent", "kind"), "at").filter("then < hops")
        before = before.groupBy("target").agg(F.max_by(F.struct("energy", "total", "then", "parent", "path", step("at", "kind").alias("step")), "then").alias("b"))
        moved = before.select("target", "b.energy", "b.total", F.col("b.then").alias("hops"), F.col("b.parent").alias("at"), F.when(F.col("b.then") > 0, F.concat(F.array("b.step"), F.col("b.path"))).otherwise(F.col("b.path")).alias("path"))
        if open_.isEmpty():
            break
        walk = cut(walk.filter("at is null").unionByName(moved))
    return walk.select("target", "energy", F.col("total").alias("hops"), "path")
