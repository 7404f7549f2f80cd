"""All queries of the memory engine with their SQL: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import decay, errors, temporal
from ..operators import evidence, folds, graphs, retrieval, sessions, upserts
from ..sources.tables import NOW, memories, outcomes, read, session_events, supply_edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MEM = """memories AS (
  SELECT d.doc_id AS id, text AS content,
    CASE WHEN d.doc_id % 7 = 0 THEN 'global' ELSE 'project:' || source END AS scope,
    CASE lang WHEN 'en' THEN 'Semantic' WHEN 'de' THEN 'Episodic' WHEN 'fr' THEN 'Procedural' ELSE 'NegativePattern' END AS memory_type,
    (['Core','Working','Peripheral','Peripheral'])[d.doc_id % 4 + 1] AS tier,
    (d.doc_id % 11) / 10.0::DOUBLE AS importance,
    CASE WHEN quality = 0 THEN 3.0::DOUBLE ELSE 8.0::DOUBLE END / 10.0::DOUBLE AS confidence,
    TIMESTAMP '2024-01-01 00:00:00' + (d.doc_id % 30) * INTERVAL 1 DAY AS valid_from,
    CASE WHEN toxic = 1 THEN TIMESTAMP '2024-01-01 00:00:00' + (d.doc_id % 30 + 10) * INTERVAL 1 DAY END AS valid_until,
    (['main','feature-a','feature-b',NULL])[d.doc_id % 4 + 1] AS branch,
    CASE WHEN toxic = 1 THEN 'Deprecated' ELSE 'Active' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
LOG = """log AS (
  SELECT user_id AS session_id, event_id AS seq, ts, value, props,
    CASE event_type WHEN 'error' THEN 'ErrorObserved' WHEN 'purchase' THEN 'TaskCompleted' WHEN 'view' THEN 'ObservationReceived' WHEN 'click' THEN 'ToolInvoked' ELSE 'SessionStarted' END AS event_type
  FROM events)"""
AGE = f"(epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 3600.0::DOUBLE"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _now():
    return F.lit(NOW).cast("timestamp")


def _age():
    return (F.unix_timestamp(_now()) - F.unix_timestamp("ts")) / F.lit(3600.0)


@query(
    f"""WITH u AS (SELECT user_id, count(*) AS n, min({AGE}) AS age, sum(greatest({AGE}, 0.0001) ** -0.5) AS traces, (user_id % 11) / 10.0::DOUBLE AS importance FROM events GROUP BY user_id)
SELECT user_id AS memory_id, n AS accesses, round(24.0 * (1 + 0.1 * ln(n + 1) + 0.2 * importance), 6) AS stability,
  round(exp(-age / (24.0 * (1 + 0.1 * ln(n + 1) + 0.2 * importance))), 6) AS retention,
  round(ln(traces) + 0.5 * importance + 0.5 * 0.9, 6) AS activation,
  exp(-age / (24.0 * (1 + 0.1 * ln(n + 1) + 0.2 * importance))) < 0.05 AS expired FROM u"""
)
def retention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select(F.col("user_id").alias("memory_id"), _age().alias("age"))
    use = log.groupBy("memory_id").agg(F.count(F.lit(1)).alias("accesses"), F.min("age").alias("age"), F.sum(decay.trace(F.col("age"))).alias("traces"))
    use = use.withColumn("importance", F.col("memory_id") % 11 / F.lit(10.0)).withColumn("s", decay.stability(F.col("accesses"), F.col("importance")))
    kept = decay.retention(F.col("age"), F.col("s"))
    return use.select(
        "memory_id", "accesses", F.round("s", 6).alias("stability"), F.round(kept, 6).alias("retention"),
        F.round(decay.activation(F.col("traces"), F.col("importance"), F.lit(0.9)), 6).alias("activation"), (kept < decay.PRUNE_BELOW).alias("expired"),
    )


@query(
    f"""WITH {MEM}, r AS (SELECT id, tier, epoch(TIMESTAMP '{NOW}' - valid_from) / 3600.0 AS age, 24.0 * (1 + 0.2 * importance) AS s FROM memories)
SELECT id, tier, round(CASE tier WHEN 'Core' THEN 1.0 WHEN 'Working' THEN 0.95 ELSE exp(-age / s) END, 6) AS retention,
  round(CASE tier WHEN 'Core' THEN 10.0 WHEN 'Working' THEN 5.0 ELSE s END, 6) AS strength FROM r"""
)
def tiered_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    age = (F.unix_timestamp(_now()) - F.unix_timestamp("valid_from")) / F.lit(3600.0)
    s = decay.stability(F.lit(0), F.col("importance"))
    return m.select("id", "tier", F.round(decay.by_tier("tier", decay.retention(age, s), 1.0, 0.95), 6).alias("retention"), F.round(decay.by_tier("tier", s, 10.0, 5.0), 6).alias("strength"))


@query(
    f"""WITH {MEM}, r AS (SELECT scope, tier = 'Peripheral' AND exp(-(epoch(TIMESTAMP '{NOW}' - valid_from) / 3600.0) / (24.0 * (1 + 0.2 * importance))) < 0.05 AS gone FROM memories)
SELECT scope, count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS archived FROM r GROUP BY scope"""
)
def prune_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.unix_timestamp(_now()) - F.unix_timestamp("valid_from")) / F.lit(3600.0)
    gone = (F.col("tier") == "Peripheral") & (decay.retention(age, decay.stability(F.lit(0), F.col("importance"))) < decay.PRUNE_BELOW)
    kept, archived = upserts.split(memories(spark, sf_dir), gone)
    both = kept.withColumn("a", F.lit(0)).unionByName(archived.withColumn("a", F.lit(1)))
    return both.groupBy("scope").agg(F.count_if(F.col("a") == 0).alias("kept"), F.count_if(F.col("a") == 1).alias("archived"))


@query(f"WITH {MEM} SELECT id, scope, memory_type FROM memories WHERE valid_from <= TIMESTAMP '2024-01-20 00:00:00' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-20 00:00:00')")
def as_of_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).filter(temporal.active_at(F.lit("2024-01-20 00:00:00").cast("timestamp"))).select("id", "scope", "memory_type")


@query(f"WITH {MEM} SELECT id, scope, tier FROM memories WHERE scope IN ('project:src1', 'project:src3', 'global') AND memory_type IN ('Semantic', 'Procedural')")
def scoped_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).filter(temporal.in_scopes(["project:src1", "project:src3"]) & F.col("memory_type").isin("Semantic", "Procedural"))
    return m.select("id", "scope", "tier")


@query(f"WITH {MEM} SELECT id, branch FROM memories WHERE branch IS NULL OR branch IN ('main', 'master', 'feature-a')")
def branch_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).filter(temporal.branch_visible("feature-a")).select("id", "branch")


@query(f"WITH {MEM} SELECT scope, status, count(*) AS n, round(avg(importance), 6) AS mean_importance FROM memories GROUP BY scope, status")
def counts_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).groupBy("scope", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("importance"), 6).alias("mean_importance"))


@query(
    """SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS state, arg_max(event_id, (ts, event_id)) AS version, floor(epoch(max(ts)))::BIGINT AS updated FROM events GROUP BY user_id"""
)
def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", "event_id", "event_type")
    return upserts.latest(log, "id", "ts", "event_id").select("id", F.col("event_type").alias("state"), F.col("event_id").alias("version"), F.unix_timestamp("ts").alias("updated"))


@query(
    """WITH f AS (SELECT 'user ' || (user_id % 20) || ' failed' AS signature, ts FROM events WHERE event_type = 'error')
SELECT signature, count(*) AS occurrences, floor(epoch(min(ts)))::BIGINT AS first_seen, floor(epoch(max(ts)))::BIGINT AS last_seen,
  CASE WHEN count(*) >= 50 THEN 'critical' WHEN count(*) >= 20 THEN 'high' WHEN count(*) >= 5 THEN 'medium' ELSE 'low' END AS severity FROM f GROUP BY signature"""
)
def failure_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").filter("event_type = 'error'")
    log = log.select(F.concat(F.lit("user "), F.col("user_id") % 20, F.lit(" failed")).alias("signature"), F.unix_timestamp("ts").alias("at"))
    return upserts.failure_upsert(log, "signature", "at").withColumn("severity", errors.severity(F.col("occurrences")))


@query(
    """WITH o AS (SELECT event_id AS seq, user_id % 5 AS workspace, event_type = 'purchase' AS synced, (event_id % 12)::INT AS retries, ts FROM events),
d AS (SELECT *, least(300.0, 2.0 ** greatest(retries - 1, 0)) AS wait FROM o)
SELECT workspace, count(*) AS pending, min(seq) AS next_seq, round(sum(wait), 6) AS wait_seconds FROM d WHERE NOT synced AND epoch(ts) + wait <= epoch(TIMESTAMP '2024-01-20 00:00:00') GROUP BY workspace"""
)
def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 5).alias("workspace"), (F.col("event_type") == "purchase").alias("synced"), errors.backoff_seconds((F.col("event_id") % 12).cast("int")).alias("wait"), "ts")
    due = o.filter(~F.col("synced") & (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("wait")) <= F.lit("2024-01-20 00:00:00").cast("timestamp")))
    return due.groupBy("workspace").agg(F.count(F.lit(1)).alias("pending"), F.min("seq").alias("next_seq"), F.round(F.sum("wait"), 6).alias("wait_seconds"))


@query("SELECT user_id % 5 AS workspace, count(*) FILTER (event_type <> 'purchase') AS unsynced, coalesce(max(event_id), 0) AS last_seq FROM events GROUP BY 1")
def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 5).alias("workspace")).agg(F.count_if(F.col("event_type") != "purchase").alias("unsynced"), F.coalesce(F.max("event_id"), F.lit(0)).alias("last_seq"))


@query("SELECT user_id AS agent_id, floor(epoch(max(ts)))::BIGINT AS heartbeat FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY")
def active_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("agent_id")).agg(F.unix_timestamp(F.max("ts")).alias("heartbeat"))
    return e.filter(F.col("heartbeat") >= F.unix_timestamp(F.lit("2024-01-29 00:00:00").cast("timestamp")))


@query(
    """WITH l AS (SELECT l_partkey AS resource, l_orderkey AS holder, epoch(l_shipdate)::BIGINT AS expires FROM lineitem)
SELECT resource, count(DISTINCT holder) AS claims, arg_min(holder, (-expires, holder)) AS holder, max(expires) AS expires FROM l GROUP BY resource HAVING count(DISTINCT holder) > 1"""
)
def lease_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("resource"), F.col("l_orderkey").alias("holder"), F.unix_timestamp("l_shipdate").alias("expires"))
    per = l.groupBy("resource", "holder").agg(F.max("expires").alias("expires"))
    out = per.groupBy("resource").agg(F.count(F.lit(1)).alias("claims"), F.min_by("holder", F.struct((-F.col("expires")).alias("e"), "holder")).alias("holder"), F.max("expires").alias("expires"))
    return out.filter("claims > 1")


@query(
    """WITH t AS (SELECT o_orderkey AS task, o_orderstatus AS status, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS needs FROM orders)
SELECT t.task, t.needs FROM t LEFT JOIN orders d ON d.o_orderkey = t.needs WHERE t.status = 'O' AND (t.needs IS NULL OR d.o_orderstatus = 'F')"""
)
def task_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    t = o.select(F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("status"), F.lag("o_orderkey").over(w).alias("needs"), F.lag("o_orderstatus").over(w).alias("needs_status"))
    return t.filter((F.col("status") == "O") & (F.col("needs").isNull() | (F.col("needs_status") == "F"))).select("task", "needs")


@query(
    """WITH a AS (SELECT p_partkey, p_brand AS domain FROM part), q AS (SELECT DISTINCT p_type AS topic FROM part)
SELECT topic, max(domain) AS domain, count(*) AS n FROM q JOIN (SELECT DISTINCT p_type AS t, p_brand AS domain FROM part WHERE p_size >= 25) a2 ON a2.t = topic GROUP BY topic"""
)
def authority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    topics = p.select(F.col("p_type").alias("topic")).distinct()
    known = p.filter("p_size >= 25").select(F.col("p_type").alias("topic"), F.col("p_brand").alias("domain")).distinct()
    return topics.join(known, "topic").groupBy("topic").agg(F.max("domain").alias("domain"), F.count(F.lit(1)).alias("n"))


BM25_SQL = f"""WITH {MEM}, t AS (SELECT id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS terms FROM memories),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS mean FROM t),
h AS (SELECT id, len(terms) AS length, q.term, len(list_filter(terms, lambda x: x = q.term)) AS tf FROM t, (VALUES ('license'), ('version'), ('idiot'), ('thorin')) q(term)),
f AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY term),
b AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM h JOIN f USING (term), s WHERE tf > 0 GROUP BY id)"""
TERMS = ["license", "version", "idiot", "thorin"]


@query(BM25_SQL + " SELECT id, round(score, 6) AS score FROM b ORDER BY score DESC, id LIMIT 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.rank_list(retrieval.bm25(read(spark, sf_dir, "documents"), TERMS, "doc_id", "text"), 50)
    return best.select("id", F.round("score", 6).alias("score"))


COS = "list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, score): cosine of every vector with that of the smallest id, one row that is joined in."""
    e = read(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(q)).select(F.col("vec_id").alias("id"), retrieval.cosine(F.col("embedding"), F.col("q")).alias("score"))


@query(f"WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id AS id, round({COS}, 5) AS score FROM embeddings e, q ORDER BY {COS} DESC, vec_id LIMIT 25")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).orderBy(F.desc("score"), "id").limit(25).select("id", F.round("score", 5).alias("score"))


@query(
    f"""{BM25_SQL}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
l1 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM b), l2 AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {COS} DESC, vec_id) AS r FROM embeddings e, q),
l3 AS (SELECT id, row_number() OVER (ORDER BY valid_from DESC, id) AS r FROM memories),
u AS (SELECT id, 0.4 / (60 + r) AS p FROM l1 WHERE r <= 60 UNION ALL SELECT id, 0.4 / (60 + r) FROM l2 WHERE r <= 100 UNION ALL SELECT id, 0.15 / (60 + r) FROM l3 WHERE r <= 60),
fused AS (SELECT id, sum(p) AS s FROM u GROUP BY id)
SELECT fused.id, round(s * (0.8 + 0.4 * importance) * (0.5 + 0.5 * confidence) * CASE WHEN branch = 'main' THEN 1.35 ELSE 1.0 END, 8) AS score
FROM fused JOIN memories m ON m.id = fused.id WHERE status <> 'Deprecated' ORDER BY s * (0.8 + 0.4 * importance) * (0.5 + 0.5 * confidence) * CASE WHEN branch = 'main' THEN 1.35 ELSE 1.0 END DESC, fused.id LIMIT 20"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: words, vectors and recency fused by reciprocal rank, weighed by quality and branch."""
    m = memories(spark, sf_dir)
    recent = m.select("id", F.col("valid_from").alias("score"))
    lists = {
        "words": (retrieval.rank_list(retrieval.bm25(read(spark, sf_dir, "documents"), TERMS, "doc_id", "text"), 60), 0.4),
        "vectors": (retrieval.rank_list(_vectors(spark, sf_dir), 100), 0.4),
        "recency": (retrieval.rank_list(recent, 60), 0.15),
    }
    fused = retrieval.fuse(lists).join(m.drop("content"), "id").filter("status <> 'Deprecated'")
    score = F.col("score") * retrieval.quality(F.col("importance"), F.col("confidence")) * F.when(F.col("branch") == "main", 1.35).otherwise(1.0)
    return fused.select("id", score.alias("s")).orderBy(F.desc("s"), "id").limit(20).select("id", F.round("s", 8).alias("score"))


@query(
    f"""WITH {MEM}, g AS (SELECT scope = 'global' AS is_global, id, importance, confidence, row_number() OVER (PARTITION BY scope = 'global' ORDER BY importance DESC, id) AS r FROM memories)
SELECT id, round(CASE WHEN is_global THEN 0.8 ELSE 1.0 END / (60 + r) * (0.8 + 0.4 * importance) * (0.5 + 0.5 * confidence), 8) AS score FROM g WHERE r <= 40"""
)
def rrf_federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    ranked = lambda cond: retrieval.rank_list(m.filter(cond).select("id", F.col("importance").alias("score")), 40)
    fused = retrieval.fuse({"local": (ranked("scope <> 'global'"), 1.0), "global": (ranked("scope = 'global'"), 0.8)})
    return fused.join(m.select("id", "importance", "confidence"), "id").select("id", F.round(F.col("score") * retrieval.quality(F.col("importance"), F.col("confidence")), 8).alias("score"))


@query("SELECT label, count(*) AS n, count(embedding) AS with_vector, round(avg(list_sum(embedding::DOUBLE[])), 4) AS mean_sum FROM embeddings GROUP BY label")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("with_vector"), F.round(F.avg(total), 4).alias("mean_sum"))


@query("SELECT label, i AS dim, round(avg(v), 5) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def centroid_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("value"))


EDGES = "edges AS (SELECT 'mem:' || l_partkey AS src, 'fact:' || l_suppkey AS dst, count(*) AS n FROM lineitem GROUP BY ALL)"


@query(
    f"""WITH {EDGES}, both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
h1 AS (SELECT DISTINCT dst AS node FROM both_ WHERE src = 'mem:1'),
h2 AS (SELECT DISTINCT b.dst AS node FROM h1 JOIN both_ b ON b.src = h1.node WHERE b.dst <> 'mem:1' AND b.dst NOT IN (SELECT node FROM h1))
SELECT 'mem:1' AS node, 0 AS hops UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2"""
)
def hop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two hops of a part. Repeated line items are repeated edges, which reach the same nodes."""
    lines = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("mem:"), F.col("l_partkey")).alias("src"), F.concat(F.lit("fact:"), F.col("l_suppkey")).alias("dst"))
    both = lines.unionByName(lines.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graphs.hop_distances(both, spark.createDataFrame([("mem:1",)], "node string"))


def _hop_sql(n: int) -> str:
    return f"""x{n} AS (SELECT e.dst AS node, sum(s.energy * e.weight * 0.65) AS got FROM s{n - 1} s JOIN w e ON e.src = s.node WHERE s.energy >= 0.05 AND s.energy * e.weight * 0.65 >= 0.005 GROUP BY e.dst),
s{n} AS (SELECT coalesce(s.node, x.node) AS node, CASE WHEN x.got IS NULL THEN s.energy ELSE least(1.0, 0.2 * coalesce(s.energy, 0.0) + x.got) END AS energy FROM s{n - 1} s FULL JOIN x{n} x ON x.node = s.node)"""


@query(
    f"""WITH {EDGES}, w0 AS (SELECT src, dst, CASE WHEN n > 1 THEN 0.95 ELSE 0.6 END::DOUBLE AS weight FROM edges), w AS (SELECT * FROM w0 UNION ALL SELECT dst, src, weight * 0.85 FROM w0),
s0 AS (SELECT node, 1.0::DOUBLE AS energy FROM (VALUES ('mem:1'), ('mem:2'), ('fact:3')) v(node)), {_hop_sql(1)}, {_hop_sql(2)}, {_hop_sql(3)}
SELECT node, round(energy, 6) AS energy FROM s3"""
)
def diffusion_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = supply_edges(spark, sf_dir).select("src", "dst", F.when(F.col("n") > 1, 0.95).otherwise(0.6).alias("weight"))
    seeds = spark.createDataFrame([(n, 1.0) for n in ("mem:1", "mem:2", "fact:3")], "node string, energy double")
    return graphs.diffuse(graphs.with_reverse(edges), seeds).select("node", F.round("energy", 6).alias("energy"))


DEPS = "deps AS (SELECT DISTINCT l_orderkey AS src, l_orderkey // 2 AS dst FROM lineitem WHERE l_orderkey > 1)"


@query(
    f"""WITH RECURSIVE {DEPS}, c AS (SELECT 3::BIGINT AS node, 0 AS depth UNION ALL SELECT d.src, c.depth + 1 FROM c JOIN deps d ON d.dst = c.node WHERE c.depth < 6)
SELECT node, min(depth) AS depth FROM c WHERE depth > 0 GROUP BY node"""
)
def closure_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = read(spark, sf_dir, "lineitem").filter("l_orderkey > 1").select(F.col("l_orderkey").alias("src"), F.expr("l_orderkey div 2").alias("dst")).distinct()
    return graphs.dependents_closure(deps, spark.createDataFrame([(3,)], "node long"), 6)


@query(
    """WITH t AS (SELECT o_orderkey AS node, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS level FROM orders)
SELECT node, level::INT AS level FROM t"""
)
def dag_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    t = o.select(F.col("o_orderkey").alias("node"), F.lag("o_orderkey").over(w).alias("needs"))
    return graphs.waves(t.select("node"), t.filter("needs is not null"))


@query(
    """WITH e AS (SELECT l_partkey, l_suppkey, count(*) AS n, bool_or(l_returnflag = 'R') AS breaking FROM lineitem GROUP BY ALL),
d AS (SELECT l_suppkey AS target, count(*) FILTER (n > 1) * 0.9::DOUBLE + count(*) FILTER (n <= 1) * 0.5::DOUBLE AS direct, bool_or(breaking) AS breaking FROM e GROUP BY 1)
SELECT target, round(greatest(0.05::DOUBLE, least(1.0::DOUBLE, (0.3::DOUBLE * (direct / 100) + 0.15::DOUBLE * 0.5::DOUBLE * (direct / 200)) * CASE WHEN breaking THEN 1.4::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN target % 5 = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS risk FROM d"""
)
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("breaking"))
    d = l.groupBy(F.col("l_suppkey").alias("target")).agg((F.count_if(F.col("n") > 1) * 0.9 + F.count_if(F.col("n") <= 1) * 0.5).alias("direct"), F.bool_or("breaking").alias("breaking"))
    risk = graphs.blast_risk(F.col("direct") / 100, F.col("direct") / 200, F.col("breaking"), F.col("target") % 5 == 0)
    return d.select("target", F.round(risk, 6).alias("risk"))


@query(
    f"""WITH {EDGES}, l AS (SELECT DISTINCT src AS node, hash_ AS label FROM (SELECT src, CAST(substr(src, 5) AS BIGINT) % 4 AS hash_ FROM edges) UNION SELECT DISTINCT dst, CAST(substr(dst, 6) AS BIGINT) % 4 FROM edges),
s AS (SELECT a.label AS la, b.label AS lb, n::DOUBLE AS w FROM edges JOIN l a ON a.node = src JOIN l b ON b.node = dst), m AS (SELECT sum(w) AS m FROM s),
k AS (SELECT label, sum(w) AS degree FROM (SELECT la AS label, w FROM s UNION ALL SELECT lb, w FROM s) GROUP BY label), i AS (SELECT la AS label, sum(w) FILTER (la = lb) AS inside FROM s GROUP BY la)
SELECT round(sum(coalesce(inside, 0) / m - (degree / (2 * m)) ** 2), 6) AS modularity FROM k LEFT JOIN i USING (label), m"""
)
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supply_edges(spark, sf_dir).select("src", "dst", F.col("n").cast("double").alias("weight"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    labels = nodes.withColumn("label", F.substring_index("node", ":", -1).cast("long") % 4)
    return graphs.modularity(e, labels).select(F.round("modularity", 6).alias("modularity"))


PROPAGATIONS = 10


def _propagated(n: int) -> str:
    return f"r{n} AS MATERIALIZED (SELECT node, arg_min(label, (-w, label)) AS label FROM (SELECT b.src AS node, r.label, sum(w) AS w FROM b JOIN r{n - 1} r ON r.node = b.dst GROUP BY ALL) GROUP BY node)"


@query(
    f"""WITH {EDGES}, w AS (SELECT src, dst, n::DOUBLE AS w FROM edges UNION ALL SELECT dst, src, n::DOUBLE FROM edges), b AS MATERIALIZED (SELECT * FROM w UNION ALL SELECT DISTINCT src, src, 0.5::DOUBLE FROM w),
r0 AS (SELECT DISTINCT src AS node, src AS label FROM b), {', '.join(_propagated(i + 1) for i in range(PROPAGATIONS))} SELECT node, label FROM r{PROPAGATIONS}"""
)
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.label_propagation(supply_edges(spark, sf_dir).select("src", "dst", F.col("n").cast("double").alias("weight")), PROPAGATIONS)


OUT = "o AS (SELECT user_id AS memory_id, event_type = 'error' AS bad FROM events WHERE event_type IN ('error', 'purchase'))"


@query(
    f"""WITH {OUT} SELECT memory_id, count(*) AS total, count(*) FILTER (NOT bad) AS successes, count(*) FILTER (bad) AS failures,
round((count(*) FILTER (NOT bad)) / count(*)::DOUBLE, 6) AS efficacy, count(*) >= 3 AND (count(*) FILTER (bad)) / count(*)::DOUBLE > 0.6 AS poisoned FROM o GROUP BY memory_id"""
)
def injection_efficacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.efficacy(outcomes(spark, sf_dir)).select("memory_id", "total", "successes", "failures", F.round("efficacy", 6).alias("efficacy"), "poisoned")


@query(
    f"""WITH {OUT}, e AS (SELECT memory_id FROM o GROUP BY memory_id HAVING count(*) >= 3 AND (count(*) FILTER (bad)) / count(*)::DOUBLE > 0.6), {MEM}
SELECT id, round(CASE WHEN memory_id IS NULL THEN importance ELSE importance * 0.1 END, 6) AS importance, memory_id IS NOT NULL AS quarantined FROM memories LEFT JOIN e ON memory_id = id"""
)
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = evidence.efficacy(outcomes(spark, sf_dir)).filter("poisoned").select(F.col("memory_id").alias("id"), F.lit(True).alias("bad"))
    m = memories(spark, sf_dir).join(bad, "id", "left")
    hit = F.col("bad").isNotNull()
    return m.select("id", F.round(F.when(hit, F.col("importance") * evidence.PENALTY).otherwise(F.col("importance")), 6).alias("importance"), hit.alias("quarantined"))


@query(
    f"""WITH {LOG} SELECT session_id, count(*) AS n_events, round(greatest(0.0, least(1.0, sum(CASE event_type WHEN 'ErrorObserved' THEN 0.35 WHEN 'ToolInvoked' THEN 0.10 WHEN 'TaskCompleted' THEN 0.4 ELSE 0 END)::DOUBLE
+ least(0.25, sum(length(coalesce(props, ''))) / 5000.0) + least(0.2, count(*) / 10.0))), 6) AS salience FROM log GROUP BY session_id"""
)
def session_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.salience(session_events(spark, sf_dir)).select("session_id", "n_events", F.round("salience", 6).alias("salience"))


@query(
    f"""WITH {LOG}, l AS (SELECT session_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM log WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)),
g AS (SELECT session_id, a || '>' || b AS ngram FROM l WHERE b IS NOT NULL UNION ALL SELECT session_id, a || '>' || b || '>' || c FROM l WHERE c IS NOT NULL)
SELECT ngram, count(DISTINCT session_id) AS support, count(*) AS occurrences FROM g GROUP BY ngram"""
)
def ngram_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sequence_support(session_events(spark, sf_dir))


@query(
    f"""WITH {LOG}, m AS (SELECT session_id, event_type, seq, lead(event_type) OVER w AS nt, lead(seq) OVER w AS ns FROM log WHERE event_type IN ('ErrorObserved', 'TaskCompleted') WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq))
SELECT session_id, seq AS error_seq, ns AS fix_seq FROM m WHERE event_type = 'ErrorObserved' AND nt = 'TaskCompleted'"""
)
def failure_fix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.fixes(session_events(spark, sf_dir))


@query(
    f"""WITH {LOG}, g AS (SELECT session_id, floor(epoch(ts))::BIGINT AS t0, ts, seq, lag(floor(epoch(ts))::BIGINT) OVER w AS before FROM log WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)),
p AS (SELECT *, sum(CASE WHEN t0 - before > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS part FROM g)
SELECT session_id, part::BIGINT AS part, count(*) AS n, min(t0) AS first, max(t0) AS last FROM p GROUP BY session_id, part"""
)
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.idle_sessions(session_events(spark, sf_dir), 86_400)


@query(
    """WITH e AS (SELECT conv_id, count(*) AS steps, count(*) FILTER (length(text) >= 40) AS ok, sum(length(text)) AS size FROM conversations GROUP BY conv_id)
SELECT conv_id, steps, ok, round(0.7 * ok / greatest(steps, 1) + 0.3 * least(1.0, size / 2000.0), 6) AS reward FROM e"""
)
def episode_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.length("text") >= 40).alias("ok"), F.sum(F.length("text")).alias("size"))
    reward = sessions.replay_reward(F.col("ok"), F.col("steps"), F.least(F.lit(1.0), F.col("size") / F.lit(2000.0)))
    return c.select("conv_id", "steps", "ok", F.round(reward, 6).alias("reward"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS reply, lead(role) OVER w AS reply_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, turn, text AS instruction, reply AS output FROM t WHERE role = 'user' AND reply_role = 'assistant'"""
)
def sft_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = read(spark, sf_dir, "conversations").withColumn("output", F.lead("text").over(w)).withColumn("reply_role", F.lead("role").over(w))
    return t.filter("role = 'user' and reply_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("instruction"), "output")


@query(
    f"""WITH {LOG} SELECT session_id AS prompt_session, seq AS sample, event_type = 'TaskCompleted' AS label FROM log WHERE event_type IN ('TaskCompleted', 'ErrorObserved')"""
)
def kto_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = session_events(spark, sf_dir).filter(F.col("event_type").isin("TaskCompleted", "ErrorObserved"))
    return e.select(F.col("session_id").alias("prompt_session"), F.col("seq").alias("sample"), (F.col("event_type") == "TaskCompleted").alias("label"))


@query(
    f"""WITH {LOG}, good AS (SELECT session_id, min(seq) AS chosen FROM log WHERE event_type = 'TaskCompleted' GROUP BY 1), bad AS (SELECT session_id, min(seq) AS rejected FROM log WHERE event_type = 'ErrorObserved' GROUP BY 1)
SELECT session_id, chosen, rejected FROM good JOIN bad USING (session_id)"""
)
def dpo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = session_events(spark, sf_dir).groupBy("session_id").agg(
        F.min(F.when(F.col("event_type") == "TaskCompleted", F.col("seq"))).alias("chosen"), F.min(F.when(F.col("event_type") == "ErrorObserved", F.col("seq"))).alias("rejected")
    )
    return firsts.filter("chosen is not null and rejected is not null")


@query(
    f"""WITH {LOG} SELECT count(*) FILTER (event_type = 'TaskCompleted') AS positives, count(*) FILTER (event_type = 'ErrorObserved') AS negatives, count(DISTINCT session_id) AS sessions,
(SELECT count(*) FROM conversations WHERE role = 'assistant') AS replies, (SELECT count(*) FROM conversations WHERE role = 'user') AS prompts FROM log"""
)
def alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = session_events(spark, sf_dir).agg(F.count_if(F.col("event_type") == "TaskCompleted").alias("positives"), F.count_if(F.col("event_type") == "ErrorObserved").alias("negatives"), F.count_distinct("session_id").alias("sessions"))
    c = read(spark, sf_dir, "conversations").agg(F.count_if(F.col("role") == "assistant").alias("replies"), F.count_if(F.col("role") == "user").alias("prompts"))
    return a.join(F.broadcast(c))  # one row each


@query(
    """WITH s AS (SELECT event_id AS id, event_type AS stratum, round(0.5 * value / (1 + value) + 0.5 * (event_id % 7) / 7.0, 9) AS priority FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY priority DESC, id) AS place FROM s)
SELECT id, stratum, place::INT AS place FROM r WHERE place <= CASE stratum WHEN 'error' THEN 40 WHEN 'purchase' THEN 40 WHEN 'view' THEN 20 ELSE 0 END"""
)
def replay_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("stratum"),
        F.round(F.lit(0.5) * F.col("value") / (1 + F.col("value")) + F.lit(0.5) * (F.col("event_id") % 7) / F.lit(7.0), 9).alias("priority"),
    )
    return sessions.stratified(s, "stratum", {"error": 40, "purchase": 40, "view": 20}, "priority", "id").select("id", "stratum", "place")


@query(
    f"""WITH {MEM}, c AS (SELECT id, scope, ceil(length(content) / 4.0)::BIGINT AS cost, sum(ceil(length(content) / 4.0)::BIGINT) OVER (PARTITION BY scope ORDER BY importance DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM memories)
SELECT id, scope, cost, running::BIGINT AS running FROM c WHERE running <= 5000"""
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.within_budget(memories(spark, sf_dir), "scope", [F.desc("importance"), F.col("id")], "content", 5000).select("id", "scope", "cost", "running")


@query(
    """WITH p AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN regexp_matches(t, 'error|fail|crash|bug') THEN 'failure' WHEN regexp_matches(t, 'before|previous|last time|remember') THEN 'history' WHEN regexp_matches(t, 'why|decid|reason') THEN 'decision' WHEN regexp_matches(t, 'how (do|to|can)|steps') THEN 'procedure' ELSE 'none' END AS intent FROM p"""
)
def recall_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", errors.recall_intent(F.col("text")).alias("intent"))


@query(
    r"""SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(props), '"[^"]*"', '<str>', 'g'), '0x[0-9a-f]+', '<hex>', 'g'), '(/[\w.-]+)+', '<path>', 'g'), '\d+', '<n>', 'g'), '\s+', ' ', 'g')) AS signature FROM events WHERE event_type = 'error'"""
)
def error_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", errors.signature(F.col("props")).alias("signature"))


@query(f"WITH {MEM} SELECT scope, count(*) AS copies, min(id) AS id FROM (SELECT md5(content) AS h, scope, id FROM memories) GROUP BY scope, h HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).select(F.md5("content").alias("h"), "scope", "id")
    return m.groupBy("scope", "h").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("id")).filter("copies > 1").select("scope", "copies", "id")


@query(f"WITH {MEM}, g AS (SELECT DISTINCT md5(content) AS h FROM memories WHERE scope = 'global') SELECT id, scope FROM memories WHERE scope <> 'global' AND md5(content) NOT IN (SELECT h FROM g)")
def transfer_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).withColumn("h", F.md5("content"))
    return m.filter("scope <> 'global'").join(m.filter("scope = 'global'").select("h"), "h", "left_anti").select("id", "scope")


@query(
    """WITH s AS (SELECT user_id AS skill, list((CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END)::DOUBLE ORDER BY ts, event_id) AS v FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT skill, round(list_reduce(list_prepend(0.5::DOUBLE, v), lambda a, x: a * 0.8::DOUBLE + x * 0.2::DOUBLE), 6) AS success_rate FROM s"""
)
def ema_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success rate of each skill: its outcomes' moving average, composed by ranges of its history."""
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error")).select(F.col("user_id").alias("skill"), "ts", "event_id", F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("x"))
    return folds.moving_average(e, "skill", ["ts", "event_id"], F.col("x"), 0.5).select("skill", F.round("average", 6).alias("success_rate"))


@query(
    f"""WITH {MEM}, f AS (SELECT scope, memory_type, id, tier, valid_from, importance, confidence, lead(id) OVER w AS id2, lead(tier) OVER w AS tier2, lead(valid_from) OVER w AS vf2, lead(importance) OVER w AS i2, lead(confidence) OVER w AS c2 FROM memories WINDOW w AS (PARTITION BY scope, memory_type ORDER BY id)),
t AS (SELECT *, CASE tier WHEN 'Core' THEN 2 WHEN 'Working' THEN 1 ELSE 0 END AS ta, CASE tier2 WHEN 'Core' THEN 2 WHEN 'Working' THEN 1 ELSE 0 END AS tb FROM f WHERE id2 IS NOT NULL)
SELECT id AS a, id2 AS b, CASE WHEN CASE WHEN ta <> tb THEN ta > tb WHEN valid_from <> vf2 THEN valid_from > vf2 WHEN abs(confidence - c2) > 0.05 THEN confidence > c2 WHEN abs(importance - i2) > 0.10 THEN importance > i2 ELSE id < id2 END THEN id ELSE id2 END AS winner FROM t"""
)
def arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("scope", "memory_type").orderBy("id")
    fact = F.struct("id", "tier", "valid_from", "confidence", "importance")
    pairs = memories(spark, sf_dir).select("scope", fact.alias("x"), F.lead(fact).over(w).alias("y")).filter("y is not null")
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), evidence.winner("x", "y").alias("winner"))


@query(
    """WITH t AS (SELECT c_mktsegment AS rule, c_acctbal, c_custkey FROM customer)
SELECT rule, count(*) AS members, round(sum(c_acctbal), 2) AS balance, max(c_custkey) AS newest FROM t GROUP BY rule"""
)
def rules_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("rule")).agg(F.count(F.lit(1)).alias("members"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.max("c_custkey").alias("newest"))


@query(
    """WITH a AS (SELECT DISTINCT l_partkey AS member, 'old' || (l_suppkey % 20) AS c FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT DISTINCT l_partkey AS member, 'new' || (l_suppkey % 20) AS c FROM lineitem WHERE l_orderkey % 2 = 1),
na AS (SELECT c, count(*) AS n FROM a GROUP BY c), nb AS (SELECT c, count(*) AS n FROM b GROUP BY c), o AS (SELECT a.c AS old_c, b.c AS new_c, count(*) AS both_ FROM a JOIN b USING (member) GROUP BY ALL),
j AS (SELECT old_c, new_c, both_ / (na.n + nb.n - both_)::DOUBLE AS jaccard FROM o JOIN na ON na.c = old_c JOIN nb ON nb.c = new_c)
SELECT old_c, arg_max(new_c, (jaccard, new_c)) AS new_c, round(max(jaccard), 6) AS jaccard FROM j GROUP BY old_c"""
)
def cluster_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    side = lambda rest, name: l.filter(F.col("l_orderkey") % 2 == rest).select(F.col("l_partkey").alias("member"), F.concat(F.lit(name[:3]), F.col("l_suppkey") % 20).alias(name)).distinct()
    a, b = side(0, "old_c"), side(1, "new_c")
    both = a.join(b, "member").groupBy("old_c", "new_c").agg(F.count(F.lit(1)).alias("both"))
    both = both.join(a.groupBy("old_c").agg(F.count(F.lit(1)).alias("na")), "old_c").join(b.groupBy("new_c").agg(F.count(F.lit(1)).alias("nb")), "new_c")
    both = both.withColumn("jaccard", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
    return both.groupBy("old_c").agg(F.max_by("new_c", F.struct("jaccard", "new_c")).alias("new_c"), F.round(F.max("jaccard"), 6).alias("jaccard"))


@query(
    """WITH RECURSIVE n AS MATERIALIZED (SELECT user_id::VARCHAR AS task, event_id AS seq, event_type = 'error' AS failed, (event_id % 5)::VARCHAR AS sig, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('error', 'purchase')),
s AS (SELECT task, 0::BIGINT AS k, 0::BIGINT AS seq, 0 AS evidence, []::VARCHAR[] AS recent, false AS futile, '' AS verdict FROM n WHERE k = 1
  UNION ALL SELECT task, k, seq, e, r, futile OR (failed AND e >= 30), CASE WHEN NOT failed OR e < 30 THEN 'Continue' WHEN futile THEN 'StillFutile' ELSE 'Futile' END
  FROM (SELECT n.task, n.k, n.seq, n.failed, s.futile AND n.failed AS futile, CASE WHEN NOT n.failed THEN floor(s.evidence * 0.25)::INT WHEN list_contains(s.recent, n.sig) THEN s.evidence + 10 ELSE s.evidence + 7 END AS e,
    CASE WHEN n.failed THEN list_append(list_filter(s.recent, lambda x: x <> n.sig), n.sig)[-8:] ELSE s.recent END AS r FROM s JOIN n ON n.task = s.task AND n.k = s.k + 1))
SELECT task, seq, evidence, verdict FROM s WHERE k > 0"""
)
def futility_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.futility import futility_batch as verdicts

    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase"))
    log = e.select(F.col("user_id").cast("string").alias("task"), F.col("event_id").alias("seq"), "ts", (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 5).cast("string").alias("signature"))
    return verdicts(log)


@query("SELECT 'user ' || (user_id % 20) AS signature, epoch(date_trunc('day', ts))::BIGINT AS start, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 2")
def gating_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.futility import recurrence

    e = read(spark, sf_dir, "events").filter("event_type = 'error'")
    log = e.select(F.concat(F.lit("user "), F.col("user_id") % 20).alias("signature"), "ts")
    return recurrence(log).select("signature", F.unix_timestamp("start").alias("start"), "n")
