"""Graph analytics on edge tables by joins and aggregations, one round a hop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut, dealt, discard, few


def strongest(edges: DataFrame) -> DataFrame:
    """Each (src, dst, kind) once, with its largest weight."""
    return edges.groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))


def with_reverse(edges: DataFrame, factor: float = 0.85) -> DataFrame:
    """Edges and their reverse at a reduced weight."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst", "weight")], (F.col("weight") * F.lit(factor)).alias("weight"))
    return edges.unionByName(back)


def hop_distances(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(node, hops) of nodes within so many hops of the seeds (node). Edges may repeat; they are read once a hop, past a small front without a shuffle."""
    reached = cut(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    front = reached
    for h in range(1, hops + 1):
        step = edges.join(few(front), F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(reached.select("node"), "node", "left_anti").withColumn("hops", F.lit(h)))
        reached = reached.unionByName(front)
    return reached


def diffuse(edges: DataFrame, energy: DataFrame, *, hops: int = 3, spread: float = 0.65, retained: float = 0.2, radiates: float = 0.05, floor: float = 0.005) -> DataFrame:
    """(node, energy) after so many hops of spreading activation.

    A node of at least `radiates` sends energy x weight x spread along its
    edges; transfers below `floor` are dropped. Receivers become
    min(1, retained x old + received); others keep their energy.
    """
    state, edges = energy, cut(edges)
    for _ in range(hops):
        sent = state.filter(F.col("energy") >= radiates).join(edges, F.col("node") == F.col("src"))
        sent = sent.select(F.col("dst").alias("node"), (F.col("energy") * F.col("weight") * F.lit(spread)).alias("sent")).filter(F.col("sent") >= floor)
        got = sent.groupBy("node").agg(F.sum("sent").alias("got"))
        state = cut(state.join(got, "node", "full_outer").select(
            "node", F.when(F.col("got").isNull(), F.col("energy")).otherwise(F.least(F.lit(1.0), F.lit(retained) * F.coalesce("energy", F.lit(0.0)) + F.col("got"))).alias("energy")
        ))
    return state


def dependents_closure(edges: DataFrame, roots: DataFrame, depth: int, may_pass: Column | None = None) -> DataFrame:
    """(node, depth) of everything that depends on the roots (node) within a depth; edges are (src depends on dst). A null or inactive node stops the walk if may_pass says so."""
    usable = cut(edges if may_pass is None else edges.filter(may_pass))
    reached = roots.select("node").distinct().withColumn("depth", F.lit(0))
    front = reached
    for d in range(1, depth + 1):
        step = front.join(usable, F.col("node") == F.col("dst")).select(F.col("src").alias("node")).distinct()
        front = cut(step.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        reached = reached.unionByName(front)
    return reached.filter("depth > 0")


def blast_risk(direct: Column, transitive: Column, breaking: Column, invariant: Column) -> Column:
    """Risk of a change from the summed edge products of direct and transitive dependents."""
    base = F.lit(0.3) * direct + F.lit(0.15) * F.lit(0.5) * transitive
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.when(breaking, base * 1.4).otherwise(base) + F.when(invariant, 0.25).otherwise(0.0)))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity) of undirected weighted edges (src, dst, weight) under labels (node, label)."""
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("la")), labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    seen = edges.join(a, "src").join(b, "dst")
    inside = seen.groupBy("la").agg(F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    ends = seen.select("la", "weight").unionByName(seen.select(F.col("lb").alias("la"), "weight"))
    degree = ends.groupBy("la").agg(F.sum("weight").alias("degree"))
    total = edges.agg(F.sum("weight").alias("m"))
    return degree.join(inside, "la", "left").join(F.broadcast(total)).agg(  # total is one row
        F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("modularity")
    )


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): synchronous propagation, heaviest label of the neighbours and oneself, ties to the smallest; deterministic.

    Nodes are numbered in their order, so rounds go by numbers and ties fall as
    between names. Rounds end early where all others are known: no label
    changes any more, or all alternate between two.
    """
    edges = cut(edges.select("src", "dst", "weight"))
    names = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    names = cut(names.orderBy("node").withColumn("id", F.monotonically_increasing_id()))
    end = lambda c, to: names.select(F.col("node").alias(c), F.col("id").alias(to))
    one = cut(edges.join(end("src", "a"), "src").join(end("dst", "b"), "dst").select("a", "b", "weight"))
    discard(edges)
    own = names.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.5).alias("weight"))
    both = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).unionByName(own))
    discard(one)
    size, none = both.count(), F.lit(None).cast("long")
    labels = cut(names.select("id", F.col("id").alias("label"), none.alias("last"), none.alias("before")))
    final = "label"
    for r in range(1, rounds + 1):
        # Dealt by the voter once, for both aggregations.
        votes = dealt(both.join(labels, F.col("b") == F.col("id")).select("a", "label", "weight"), "a", rows=size)
        most = votes.groupBy("a", "label").agg(F.sum("weight").alias("w")).groupBy(F.col("a").alias("id")).agg(F.min_by("label", F.struct((-F.col("w")).alias("w"), "label")).alias("label"))
        new = cut(most.join(labels.select("id", F.col("label").alias("last"), F.col("last").alias("before")), "id"))
        discard(labels)
        labels = new
        moved = labels.agg(*[F.count_if(~F.col("label").eqNullSafe(F.col(c))) for c in ("last", "before")]).first()
        if moved[0] == 0 or moved[1] == 0:
            final = "last" if moved[0] and (rounds - r) % 2 else "label"
            break
    labels = labels.select("id", F.col(final).alias("label"))
    discard(both)
    name = names.select(F.col("id").alias("label"), F.col("node").alias("name"))
    return labels.join(names, "id").join(name, "label").select("node", F.col("name").alias("label"))


def waves(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(node, level): longest-path layers of tasks (node) under deps (node, needs), however deep; a cycle's members, and what waits for them or for what is no task, get no level.

    A round takes what the layer before has released: only its edges are read, and the nodes with an unmet need shrink.
    """
    nodes = cut(tasks.select("node").distinct())
    deps = cut(deps.select("node", "needs").filter("needs is not null").distinct().join(nodes, "node"))
    waiting = cut(deps.groupBy("node").agg(F.count(F.lit(1)).alias("unmet")))
    front = cut(nodes.join(waiting, "node", "left_anti").withColumn("level", F.lit(0)))
    layers = []
    while not front.isEmpty():
        layers.append(front)
        met = deps.join(front.select(F.col("node").alias("needs")), "needs").groupBy("node").agg(F.count(F.lit(1)).alias("met"))
        left = cut(waiting.join(met, "node", "left").select("node", (F.col("unmet") - F.coalesce("met", F.lit(0))).alias("unmet")))
        discard(waiting)
        front, waiting = cut(left.filter("unmet = 0").select("node", F.lit(len(layers)).alias("level"))), cut(left.filter("unmet > 0"))
        discard(left)
    return reduce(DataFrame.unionByName, layers) if layers else front
