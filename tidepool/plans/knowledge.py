"""Queries over facts, episodes, call edges and plans, with their SQL; they join the catalogue of queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import evidence, graphs, retrieval
from ..sources.tables import memories, read, session_events
from .queries import LOG, MEM, query

CALLS = "calls AS (SELECT DISTINCT 'f' || (l_partkey % 50) AS file, 'p' || l_partkey AS caller, 'p' || ((l_partkey * 7 + l_suppkey) % 200 + 1) AS callee FROM lineitem)"


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, caller, callee) from line items."""
    l = read(spark, sf_dir, "lineitem")
    return l.select(
        F.concat(F.lit("f"), F.col("l_partkey") % 50).alias("file"), F.concat(F.lit("p"), F.col("l_partkey")).alias("caller"),
        F.concat(F.lit("p"), (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 200 + 1).alias("callee"),
    ).distinct()


@query(f"WITH {CALLS} SELECT callee, count(*) AS callers, min(caller) AS first_caller FROM calls GROUP BY callee")
def callers_of_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_edges(spark, sf_dir).groupBy("callee").agg(F.count(F.lit(1)).alias("callers"), F.min("caller").alias("first_caller"))


@query(f"WITH {CALLS} SELECT file, caller, count(*) AS callees FROM calls GROUP BY file, caller")
def callees_of_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_edges(spark, sf_dir).groupBy("file", "caller").agg(F.count(F.lit(1)).alias("callees"))


@query(f"WITH {CALLS} SELECT file, caller FROM calls WHERE caller = callee")
def recursive_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_edges(spark, sf_dir).filter("caller = callee").select("file", "caller")


@query(
    f"""WITH {CALLS}, home AS (SELECT caller AS symbol, min(file) AS file FROM calls GROUP BY caller), e AS (SELECT calls.file AS a, home.file AS b FROM calls JOIN home ON callee = symbol)
SELECT a AS file, count(*) FILTER (a = b) AS inside, count(*) FILTER (a <> b) AS outside, round((count(*) FILTER (a = b)) / count(*)::DOUBLE, 6) AS cohesion FROM e GROUP BY a"""
)
def cohesion_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = call_edges(spark, sf_dir)
    home = calls.groupBy(F.col("caller").alias("symbol")).agg(F.min("file").alias("home"))
    e = calls.join(home, F.col("callee") == F.col("symbol"))
    inside = F.count_if(F.col("file") == F.col("home"))
    return e.groupBy("file").agg(inside.alias("inside"), F.count_if(F.col("file") != F.col("home")).alias("outside"), F.round(inside / F.count(F.lit(1)), 6).alias("cohesion"))


@query(
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS l FROM v),
d AS (SELECT a.label, a.vec_id, sum(greatest(0.0, 1 - list_dot_product(a.e, b.e) / (a.l * b.l))) AS s FROM n a JOIN n b ON a.label = b.label GROUP BY a.label, a.vec_id)
SELECT label, arg_min(vec_id, (round(s, 5), vec_id)) AS medoid FROM d GROUP BY label"""
)
def medoid_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of least summed cosine distance in each label.

    The distances of a vector to all of its label sum to n minus its unit
    vector times the sum of the label's unit vectors, so no pairs are made.
    """
    e = read(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    unit = e.withColumn("u", F.transform("v", lambda x: x / F.sqrt(retrieval.dot(F.col("v"), F.col("v")))))
    sums = unit.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    total = sums.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("t"), F.lit(1).alias("one"))
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    s = unit.join(total, "label").join(n, "label").withColumn("s", F.round(F.col("n") - retrieval.dot(F.col("u"), F.col("t")), 5))
    return s.groupBy("label").agg(F.min_by("vec_id", F.struct("s", "vec_id")).alias("medoid"))


_HAS = lambda t, w: f"contains({t}, '{w}')"
_CUES = " + ".join(
    [f"(({_HAS('x', p)} AND {_HAS('y', q)}) OR ({_HAS('x', q)} AND {_HAS('y', p)}))::INT" for p, q in evidence.OPPOSITES]
    + [f"({_HAS('x', n)} <> {_HAS('y', n)})::INT" for n in evidence.NEGATIONS]
)


@query(
    f"""WITH {MEM}, p AS (SELECT scope, id AS a, lower(content) AS x, lead(id) OVER w AS b, lower(lead(content) OVER w) AS y FROM memories WINDOW w AS (PARTITION BY scope ORDER BY id))
SELECT a, b, {_CUES} AS cues FROM p WHERE b IS NOT NULL"""
)
def contradiction_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues between neighbouring statements of a scope, over whole texts. Each text is searched once, where it is read; neighbours meet by ids and marks."""
    m = memories(spark, sf_dir).select("scope", "id", F.lower("content").alias("low")).select("scope", "id", evidence.cue_marks(F.col("low")).alias("marks"))
    w = W.partitionBy("scope").orderBy("id")
    pairs = m.select(F.col("id").alias("a"), F.lead("id").over(w).alias("b"), "marks", F.lead("marks").over(w).alias("next")).filter("b is not null")
    return pairs.select("a", "b", evidence.marked_cues(F.col("marks"), F.col("next")).cast("int").alias("cues"))


@query(
    f"""WITH {MEM}, dep AS (SELECT id, id // 3 AS needs FROM memories WHERE id % 3 = 1), bad AS (SELECT DISTINCT dep.id FROM dep LEFT JOIN memories m ON m.id = needs AND m.status = 'Active' WHERE m.id IS NULL)
SELECT id FROM memories WHERE status = 'Active' AND id NOT IN (SELECT id FROM bad)"""
)
def belief_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active facts of which no prerequisite is missing or inactive."""
    active = memories(spark, sf_dir).filter("status = 'Active'").select("id")
    deps = memories(spark, sf_dir).filter("id % 3 = 1").select("id", F.expr("id div 3").alias("needs"))
    bad = deps.join(active.withColumnRenamed("id", "needs"), "needs", "left_anti").select("id")
    return active.join(bad, "id", "left_anti")


@query(
    """WITH n AS (SELECT doc_id, regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}]+', ' ', 'g') AS t FROM documents)
SELECT min(doc_id) AS id, count(*) AS copies FROM n GROUP BY md5(t) HAVING count(*) > 1"""
)
def normalised_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that are equal but for case (ASCII only), punctuation and blanks."""
    t = F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^\p{L}\p{N}]+", " ")
    g = read(spark, sf_dir, "documents").groupBy(F.md5(t)).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    return g.filter("copies > 1").select("id", "copies")


@query(
    """WITH t AS (SELECT conv_id, turn, role, length(text) AS size FROM conversations), leaf AS (SELECT conv_id, turn // 4 AS part, count(*) AS steps, sum(size) AS size, count(DISTINCT role) AS tools FROM t GROUP BY ALL)
SELECT conv_id, 2 AS tier, count(*) AS children, sum(steps)::BIGINT AS steps, sum(size)::BIGINT AS size, max(tools) AS tools FROM leaf GROUP BY conv_id"""
)
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as second-tier episodes over leaves of four turns."""
    c = read(spark, sf_dir, "conversations")
    leaf = c.groupBy("conv_id", F.expr("turn div 4").alias("part")).agg(F.count(F.lit(1)).alias("steps"), F.sum(F.length("text")).alias("size"), F.count_distinct("role").alias("tools"))
    return leaf.groupBy("conv_id").agg(F.lit(2).alias("tier"), F.count(F.lit(1)).alias("children"), F.sum("steps").alias("steps"), F.sum("size").alias("size"), F.max("tools").alias("tools"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS id, o_orderkey // 8 AS parent FROM orders WHERE o_orderkey > 0), t AS (SELECT id, 1 AS depth FROM e WHERE parent = 0 UNION ALL SELECT e.id, depth + 1 FROM e JOIN t ON e.parent = t.id WHERE depth < 3)
SELECT id, min(depth) AS depth FROM t GROUP BY id"""
)
def drilldown_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of episodes below the roots."""
    e = read(spark, sf_dir, "orders").filter("o_orderkey > 0").select(F.col("o_orderkey").alias("src"), F.expr("o_orderkey div 8").alias("dst"))
    return graphs.dependents_closure(e, spark.createDataFrame([(0,)], "node long"), 3).select(F.col("node").alias("id"), "depth")


@query(
    """SELECT o_orderkey AS action, round(greatest(0.05::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * (o_orderstatus <> 'F')::INT + 0.35::DOUBLE * (o_orderkey % 4) / 4 + 0.15::DOUBLE * (o_orderkey % 3) / 3)), 6) AS error,
CASE WHEN o_orderstatus <> 'F' THEN 'outcome' WHEN o_orderkey % 4 > 0 THEN 'effects' WHEN o_orderkey % 3 > 0 THEN 'conditions' ELSE 'none' END AS mismatch FROM orders"""
)
def prediction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far actions fell from what was predicted: outcome, share of missed effects, share of unmet conditions."""
    missed, key = F.col("o_orderstatus") != "F", F.col("o_orderkey")
    error = F.lit(0.5) * missed.cast("int") + F.lit(0.35) * (key % 4) / 4 + F.lit(0.15) * (key % 3) / 3
    kind = F.when(missed, "outcome").when(key % 4 > 0, "effects").when(key % 3 > 0, "conditions").otherwise("none")
    return read(spark, sf_dir, "orders").select(key.alias("action"), F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), error)), 6).alias("error"), kind.alias("mismatch"))


@query(
    """WITH h AS (SELECT l_orderkey AS incident, l_linenumber AS cause, l_discount * 2 + CASE l_returnflag WHEN 'R' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY score DESC, cause) AS place FROM h)
SELECT incident, cause, round(score, 6) AS score, round(least(0.5::DOUBLE, greatest(0.05::DOUBLE, 0.35::DOUBLE * score)), 6) AS penalty FROM r WHERE place = 1"""
)
def counterfactual_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest cause of each incident, and the confidence that it costs."""
    score = F.col("l_discount") * 2 + F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0)
    h = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("incident"), F.col("l_linenumber").alias("cause"), score.alias("score"))
    best = h.groupBy("incident").agg(F.min(F.struct((-F.col("score")).alias("s"), "cause")).alias("b")).select("incident", "b.cause", (-F.col("b.s")).alias("score"))
    penalty = F.least(F.lit(0.5), F.greatest(F.lit(0.05), F.lit(0.35) * F.col("score")))
    return best.select("incident", "cause", F.round("score", 6).alias("score"), F.round(penalty, 6).alias("penalty"))


@query(
    f"""WITH {LOG}, p AS (SELECT session_id, event_type, count(*) AS n FROM log GROUP BY ALL), u AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY md5(session_id || ':' || event_type), event_type) AS place, count(*) OVER (PARTITION BY session_id) AS total FROM p)
SELECT session_id, event_type, CASE WHEN place <= ceil(total * 0.8) THEN 'train' ELSE 'eval' END AS part FROM u"""
)
def curriculum_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct samples of each session, four fifths for training by a hash order."""
    p = session_events(spark, sf_dir).select("session_id", "event_type").distinct()
    by = W.partitionBy("session_id")
    place = F.row_number().over(by.orderBy(F.md5(F.concat(F.col("session_id"), F.lit(":"), F.col("event_type"))), "event_type"))
    total = F.count(F.lit(1)).over(by)
    return p.select("session_id", "event_type", F.when(place <= F.ceil(total * F.lit(0.8)), "train").otherwise("eval").alias("part"))


@query(
    """WITH d AS (SELECT l_partkey AS anchor, max(CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey END) AS old_hash, max(CASE WHEN l_orderkey % 2 = 1 THEN l_suppkey END) AS new_hash FROM lineitem GROUP BY l_partkey)
SELECT anchor, CASE WHEN old_hash IS NULL THEN 'added' WHEN new_hash IS NULL THEN 'deleted' WHEN old_hash = new_hash THEN 'unchanged' ELSE 'modified' END AS change FROM d"""
)
def diff_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code anchors against the current symbols: unchanged, modified, deleted or added."""
    l = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("anchor"))
    d = l.agg(F.max(F.when(F.col("l_orderkey") % 2 == 0, F.col("l_suppkey"))).alias("old"), F.max(F.when(F.col("l_orderkey") % 2 == 1, F.col("l_suppkey"))).alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return d.select("anchor", kind.alias("change"))


@query("SELECT greatest((SELECT floor(epoch(max(ts)))::BIGINT FROM events), (SELECT floor(epoch(max(o_orderdate)))::BIGINT FROM orders), (SELECT floor(epoch(max(l_shipdate)))::BIGINT FROM lineitem)) AS latest")
def latest_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = [read(spark, sf_dir, t).agg(F.unix_timestamp(F.max(c)).alias("t")) for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
    return tops[0].unionByName(tops[1]).unionByName(tops[2]).agg(F.max("t").alias("latest"))
