"""Queries of ordered state, paths, clusters and row patterns, with their SQL; they join the catalogue of queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import branches, clusters, folds, paths, symbols, trajectories
from ..runtime import dealt
from ..sources import records as rec
from ..sources.tables import read, session_events
from .queries import LOG, query

CLAIMS = "claims AS (SELECT l_suppkey AS resource, l_partkey % 7 AS holder, floor(epoch(l_shipdate))::BIGINT AS at_, l_linenumber::BIGINT * 86400 AS ttl, l_returnflag = 'R' AND l_linenumber % 2 = 0 AS release_ FROM lineitem)"


@query(
    f"""WITH RECURSIVE {CLAIMS}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY at_, holder, release_, ttl) AS k FROM claims),
s AS (SELECT resource, k, holder, at_, CASE WHEN release_ THEN 'not held' ELSE 'granted' END AS outcome, CASE WHEN NOT release_ THEN holder END AS held_by, CASE WHEN NOT release_ THEN at_ + ttl END AS held_until FROM n WHERE k = 1
  UNION ALL SELECT n.resource, n.k, n.holder, n.at_, CASE WHEN n.release_ THEN CASE WHEN s.held_by = n.holder THEN 'released' ELSE 'not held' END WHEN s.held_by IS NULL OR s.held_until <= n.at_ OR s.held_by = n.holder THEN 'granted' ELSE 'denied' END,
    CASE WHEN n.release_ THEN CASE WHEN s.held_by = n.holder THEN NULL ELSE s.held_by END WHEN s.held_by IS NULL OR s.held_until <= n.at_ THEN n.holder ELSE s.held_by END,
    CASE WHEN n.release_ THEN CASE WHEN s.held_by = n.holder THEN NULL ELSE s.held_until END WHEN s.held_by IS NULL OR s.held_until <= n.at_ OR s.held_by = n.holder THEN n.at_ + n.ttl ELSE s.held_until END
  FROM s JOIN n ON n.resource = s.resource AND n.k = s.k + 1)
SELECT resource, holder, at_ AS "at", outcome, count(*) AS n, max(CASE WHEN outcome IN ('granted', 'denied') THEN held_until END) AS held_until FROM s GROUP BY ALL"""
)
def lease_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on leases in their order: a lease is granted if none stands, or to its holder; denied claims hold nothing."""
    claims = rec.claims(spark, sf_dir)
    done = dealt(folds.leases(claims), "resource", rows=claims.count())
    return done.groupBy("resource", "holder", "at", "outcome").agg(F.count(F.lit(1)).alias("n"), F.max("held_until").alias("held_until"))


DEFAULTS = {"Supports": 0.95, "MentionsFile": 0.80, "SharedTag": 0.50}


@query(
    """WITH RECURSIVE f AS MATERIALIZED (SELECT 'mem:' || user_id AS src, 'tag:' || (event_id % 5) AS dst, (['Supports','MentionsFile','SharedTag'])[event_id % 3 + 1] AS kind, floor(epoch(ts))::BIGINT AS at_, event_id AS seq, event_type IN ('purchase', 'click') AS good,
  CASE WHEN event_id % 12 = 0 THEN 1.0::DOUBLE ELSE least((event_id % 12) / 10.0::DOUBLE, 1.0::DOUBLE) END AS score FROM events),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src, dst, kind ORDER BY at_, seq) AS k FROM f),
s AS (SELECT src, dst, kind, 0::BIGINT AS k, CASE kind WHEN 'Supports' THEN 0.95::DOUBLE WHEN 'MentionsFile' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS w FROM n WHERE k = 1
  UNION ALL SELECT n.src, n.dst, n.kind, n.k, greatest(0.05::DOUBLE, least(1.0::DOUBLE, CASE WHEN good THEN w + 0.15::DOUBLE * score * (1 - w) ELSE w - 0.2::DOUBLE * score * w END)) FROM s JOIN n ON n.src = s.src AND n.dst = s.dst AND n.kind = s.kind AND n.k = s.k + 1)
SELECT src, dst, kind, round(arg_max(w, s.k), 6) AS weight, (SELECT count(*) FILTER (good) FROM f WHERE f.src = s.src AND f.dst = s.dst AND f.kind = s.kind) AS reinforcements, max(s.k) AS feedback FROM s GROUP BY src, dst, kind"""
)
def edge_plasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge weights after all feedback, in its order."""
    start = F.when(F.col("kind") == "Supports", DEFAULTS["Supports"]).when(F.col("kind") == "MentionsFile", DEFAULTS["MentionsFile"]).otherwise(DEFAULTS["SharedTag"])
    # Half a millionth is rounded as SQL rounds a double, after scaling it; Spark's round goes by the shortest decimal.
    done = folds.edge_weights(rec.edge_feedback(spark, sf_dir), start)
    return done.select("src", "dst", "kind", (F.round(F.col("weight") * 1_000_000) / 1_000_000).alias("weight"), "reinforcements", (F.col("reinforcements") + F.col("depressions")).alias("feedback"))


WEIGHTED = """one AS (SELECT DISTINCT 'mem:' || l_partkey AS src, 'fact:' || l_suppkey AS dst, CASE WHEN (l_partkey + l_suppkey) % 3 = 0 THEN 'Supports' ELSE 'SharedTag' END AS kind, (l_partkey * 7 + l_suppkey * 3) % 40 / 100.0::DOUBLE + 0.55::DOUBLE AS weight FROM lineitem),
edges AS (SELECT * FROM one UNION ALL SELECT dst, src, kind, weight * 0.85::DOUBLE FROM one)"""
DEPTH = 5


def _relaxed() -> str:
    """Best products by at most so many edges, with the path that gives them."""
    out = ["b0 AS (SELECT 'mem:1' AS node, 1.0::DOUBLE AS energy, 0 AS hops, []::VARCHAR[] AS path)"]
    for d in range(1, DEPTH + 1):
        offers = f"SELECT dst AS node, energy * weight AS energy, src AS parent, kind, path FROM b{d - 1} JOIN edges ON src = node"
        top = f"SELECT node, max(energy) AS energy, arg_min({{'kind': kind, 'path': path}}, (-energy, parent, kind)) AS via FROM ({offers}) GROUP BY node"
        out.append(
            f"b{d} AS MATERIALIZED (SELECT coalesce(b.node, t.node) AS node, CASE WHEN b.energy IS NULL OR t.energy > b.energy THEN t.energy ELSE b.energy END AS energy, CASE WHEN b.energy IS NULL OR t.energy > b.energy THEN {d} ELSE b.hops END AS hops, "
            f"CASE WHEN b.energy IS NULL OR t.energy > b.energy THEN list_append(via.path, via.kind || '>' || t.node) ELSE b.path END AS path FROM b{d - 1} b FULL JOIN ({top}) t ON t.node = b.node)"
        )
    return ", ".join(out)


@query(f"WITH {WEIGHTED}, {_relaxed()} SELECT node AS target, energy, hops, array_to_string(path, ' ') AS path FROM b{DEPTH}")
def activation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best path from one memory to every node within five hops."""
    steps = paths.best_paths(rec.weighted_edges(spark, sf_dir), "mem:1", DEPTH)
    found = paths.read_back(steps, steps.select("node"), DEPTH)
    text = F.array_join(F.transform("path", lambda s: F.concat(s["kind"], F.lit(">"), s["node"])), " ")
    return found.select("target", "energy", "hops", text.alias("path"))


_KIND = "CASE event_type WHEN 'ErrorObserved' THEN 'failure' WHEN 'ToolInvoked' THEN 'attempt' WHEN 'TaskCompleted' THEN 'success' ELSE 'other' END"


@query(
    f"""WITH RECURSIVE {LOG}, e AS (SELECT session_id, seq, {_KIND} AS kind, 'step' || (seq % 7) AS step, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place FROM log),
tried AS (SELECT f.session_id, f.place, f.seq, min(a.place) AS first_try FROM e f JOIN e a ON a.session_id = f.session_id AND a.kind = 'attempt' AND a.place BETWEEN f.place + 1 AND f.place + 10 WHERE f.kind = 'failure' GROUP BY ALL),
found AS MATERIALIZED (SELECT t.session_id, t.place, t.seq, min(s.place) AS until FROM tried t JOIN e s ON s.session_id = t.session_id AND s.kind = 'success' AND s.place > first_try AND s.place <= t.place + 10 GROUP BY ALL),
taken AS (SELECT session_id, min(place) AS place FROM found GROUP BY session_id UNION ALL SELECT t.session_id, (SELECT min(n.place) FROM found n WHERE n.session_id = t.session_id AND n.place >= f.until) FROM taken t JOIN found f ON f.session_id = t.session_id AND f.place = t.place WHERE t.place IS NOT NULL)
SELECT f.session_id, f.seq AS failed_at, (SELECT seq FROM e WHERE e.session_id = f.session_id AND e.place = f.until) AS recovered_at,
  (SELECT string_agg(step, ' ' ORDER BY place) FROM e WHERE e.session_id = f.session_id AND kind = 'attempt' AND e.place > f.place AND e.place < f.until) AS steps FROM found f JOIN taken t ON t.session_id = f.session_id AND t.place = f.place"""
)
def recovery_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures with the attempts that led to the next success."""
    kind = F.when(F.col("event_type") == "ErrorObserved", "failure").when(F.col("event_type") == "ToolInvoked", "attempt").when(F.col("event_type") == "TaskCompleted", "success").otherwise("other")
    log = session_events(spark, sf_dir).select("session_id", "seq", kind.alias("kind"), F.concat(F.lit("step"), F.col("seq") % 7).alias("step"))
    return trajectories.recoveries(log).select("session_id", "failed_at", "recovered_at", F.array_join("steps", " ").alias("steps"))


def _file(k: str) -> str:
    return f"'src/m' || ({k} % 12) || '/f' || ({k} % 60) || '.rs'"


@query(
    f"""WITH edges AS (SELECT DISTINCT {_file('l_partkey')} AS f, l_partkey % 2 = 1 AS odd, 's' || ((l_partkey * 3 + l_suppkey) % 300) || CASE l_linenumber % 4 WHEN 0 THEN '::new' WHEN 1 THEN '.run' ELSE '' END AS callee FROM lineitem),
bound AS (SELECT {_file('o_orderkey')} AS f, 's' || (o_orderkey % 90) AS symbol, min('src/lib/l' || (o_orderkey % 17) || '.rs') AS target FROM orders GROUP BY ALL), defs AS (SELECT DISTINCT {_file('p_partkey')} AS f, 's' || (p_partkey * 7 % 260) AS symbol FROM part),
r AS (SELECT e.f, odd, e.callee, b.target AS bound, c.target AS scoped, (SELECT min(d.f) FROM defs d WHERE d.symbol = e.callee AND d.f = e.f) AS local_, (SELECT count(*) FROM defs d WHERE d.symbol = e.callee) AS files,
  (SELECT min(d.f) FROM defs d WHERE d.symbol = e.callee AND regexp_replace(d.f, '/[^/]*$', '') = regexp_replace(e.f, '/[^/]*$', '')) AS near, (SELECT min(d.f) FROM defs d WHERE d.symbol = e.callee) AS first_
  FROM edges e LEFT JOIN bound b ON b.f = e.f AND b.symbol = e.callee LEFT JOIN bound c ON c.f = e.f AND c.symbol = regexp_extract(e.callee, '^(s[0-9]+)(::|\\.)', 1))
SELECT CASE WHEN odd THEN replace(f, '/', '\\') ELSE f END AS caller_file, callee, coalesce(bound, scoped, local_, CASE WHEN files = 1 THEN first_ END, near, first_) AS target,
  CASE WHEN bound IS NOT NULL THEN 'import' WHEN scoped IS NOT NULL THEN 'scope' WHEN local_ IS NOT NULL THEN 'local' WHEN files = 1 THEN 'only' WHEN near IS NOT NULL THEN 'near' WHEN first_ IS NOT NULL THEN 'first' END AS rule FROM r"""
)
def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the file that defines what they call, and the rule that found it."""
    return symbols.resolve_edges(*rec.call_sites(spark, sf_dir)).select("caller_file", "callee", "target", "rule")


@query(
    """WITH RECURSIVE v AS (SELECT vec_id AS id, label AS block, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY block ORDER BY id) AS k FROM v),
s AS (SELECT block, k, id, id AS leader, 0.0::DOUBLE AS distance, [{'id': id, 'u': u}] AS leaders FROM n WHERE k = 1
  UNION ALL SELECT block, k, id, CASE WHEN b.d < 0.2 THEN b.id ELSE id END, CASE WHEN b.d < 0.2 THEN b.d ELSE 0.0 END, CASE WHEN b.d < 0.2 THEN leaders ELSE list_append(leaders, {'id': id, 'u': u}) END
  FROM (SELECT n.block, n.k, n.id, n.u, s.leaders, list_sort(list_transform(s.leaders, lambda l: {'d': greatest(0.0::DOUBLE, 1 - list_dot_product(l.u, n.u)), 'id': l.id}))[1] AS b FROM s JOIN n ON n.block = s.block AND n.k = s.k + 1))
SELECT id, block, leader, round(distance, 6) AS distance FROM s"""
)
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label by leaders, in the order of their ids."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("block"), F.col("embedding").alias("vector"))
    return clusters.leader_clusters(e).select("id", "block", "leader", F.round("distance", 6).alias("distance"))


@query()
def leader_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The medoid of each cluster of vectors, where a label's vectors are dealt over several tasks."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("block"), F.col("embedding").alias("vector"))
    return clusters.medoids(clusters.leader_clusters(e, splits=clusters.SPLITS), e)


@query(
    """WITH r AS (SELECT p_partkey AS k, 'main' AS branch, 0 AS at_, p_name AS c FROM part WHERE p_partkey % 11 > 0
  UNION ALL SELECT l_partkey, CASE WHEN l_orderkey % 2 = 0 THEN 'feature' ELSE 'release' END, l_orderkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE 'part ' || (l_suppkey % 3) END FROM lineitem WHERE l_orderkey % 4 < 2 AND l_linenumber > 4),
d AS (SELECT k, branch, arg_max(coalesce(sha256(c), 'deleted'), (at_, coalesce(sha256(c), 'deleted'))) AS d FROM r GROUP BY ALL),
s AS (SELECT k, coalesce(max(d) FILTER (branch = 'main'), 'deleted') AS b, coalesce(max(d) FILTER (branch = 'feature'), max(d) FILTER (branch = 'main'), 'deleted') AS f, coalesce(max(d) FILTER (branch = 'release'), max(d) FILTER (branch = 'main'), 'deleted') AS t FROM d GROUP BY k)
SELECT k AS part, CASE WHEN f = b AND t = b THEN 'unchanged' WHEN t = b THEN 'taken' WHEN f = b THEN 'kept' WHEN f = t THEN 'agreed' ELSE 'conflict' END AS outcome, f AS source, t AS target FROM s"""
)
def branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature branch merged into a release, both from one base: parts as records, line items as their later versions."""
    base = read(spark, sf_dir, "part").filter("p_partkey % 11 > 0").select(F.col("p_partkey").alias("part"), F.lit("main").alias("branch"), F.lit(0).cast("long").alias("at"), F.col("p_name").alias("content"))
    said = F.when(F.col("l_linenumber") != 7, F.concat(F.lit("part "), F.col("l_suppkey") % 3))
    later = read(spark, sf_dir, "lineitem").filter("l_orderkey % 4 < 2 AND l_linenumber > 4").select(F.col("l_partkey").alias("part"), F.when(F.col("l_orderkey") % 2 == 0, "feature").otherwise("release").alias("branch"), F.col("l_orderkey").alias("at"), said.alias("content"))
    return branches.merge(base.unionByName(later), "part", F.col("content"), "main", "feature", "release").drop("base")


@query(
    """WITH e AS (SELECT user_id || '/' || event_type AS signature, floor(epoch(ts))::BIGINT AS at_, (event_id % 5) / 4.0::DOUBLE AS likeness, (event_id % 11) / 10.0::DOUBLE AS importance FROM events),
g AS (SELECT signature, count(*) FILTER (importance < 0.9) AS recurrences, coalesce(sum(exp(-greatest(0.0::DOUBLE, (epoch(TIMESTAMP '2024-01-20 00:00:00')::BIGINT - at_)::DOUBLE) / 86400.0::DOUBLE) * likeness) FILTER (importance < 0.9), 0.0) AS density, count(*) FILTER (importance >= 0.9) AS bypassed FROM e GROUP BY signature)
SELECT signature, recurrences, round(density, 6) AS density, bypassed, CASE WHEN recurrences >= 2 AND density >= 1.5 THEN 'consolidate' ELSE 'hold' END AS decision FROM g"""
)
def recurrence_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recurs densely enough at a moment to be consolidated, by user and kind of event."""
    k = F.col("event_id")
    e = read(spark, sf_dir, "events").select(F.concat("user_id", F.lit("/"), "event_type").alias("signature"), F.unix_timestamp("ts").alias("at"), (k % 5 / F.lit(4.0)).alias("likeness"), (k % 11 / F.lit(10.0)).alias("importance"))
    out = branches.gated(e, "signature", F.unix_timestamp(F.lit("2024-01-20 00:00:00").cast("timestamp")), 0.9)
    return out.withColumn("density", F.round("density", 6))
