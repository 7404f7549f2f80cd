"""Connected components of an edge table, by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .cluster import HOT, cut, discard


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that can be reached; nodes without edges aren't listed.

    Every round gives each node the smallest label among itself and its
    neighbours, then the label of that label, so long chains shrink by
    doubling. Rounds end when no label changes; one number a round comes to
    the driver. Edges may repeat; an empty table gives no rows.
    """
    # Written before it is read in both directions: edges that come out differently the second time would not be symmetric.
    once = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y"))
    both = cut(once.unionByName(once.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    discard(once)
    labels = cut(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")))
    # Edges of hubs, a few nodes with a large share of all, take their labels by broadcast.
    total = both.count()
    hubs = cut(both.groupBy("y").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > total / HOT).select("y"))  # HOT rows at most
    apart = both.join(F.broadcast(hubs), "y", "left_anti")
    around = both.join(F.broadcast(hubs), "y", "left_semi")
    state = None
    while True:
        of = labels.select(F.col("node").alias("y"), "label")
        near = apart.join(of, "y").unionByName(around.join(F.broadcast(of.join(F.broadcast(hubs), "y", "left_semi")), "y"))
        near = near.groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", F.least("label", "near").alias("label"))
        # Only labels that moved on matter, and most soon rest.
        far = step.filter("label <> node").select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = cut(step.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label")))
        now = new.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)")).alias("s")).first()["s"]
        discard(labels)
        labels = new
        if now == state:
            discard(both)
            discard(hubs)
            return labels.select("node", F.col("label").alias("component"))
        state = now
