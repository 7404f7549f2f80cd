"""Queries of the kept index and of whole retrieval, with their SQL; they join the catalogue of queries.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import temporal
from ..operators import evidence, graphs, retrieval, search
from ..runtime import shared_folder
from ..sources import records as rec
from ..sources.tables import memories, outcomes, read
from .beliefs import BELIEFS
from .queries import COS, MEM, query

MOMENT = "2024-01-20 00:00:00"
ALIVE = f"valid_from <= TIMESTAMP '{MOMENT}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{MOMENT}')"


def _index(spark: SparkSession) -> search.Index:
    return search.Index(spark, f"{shared_folder(spark).rstrip('/')}/tidepool-index-{uuid.uuid4().hex}")


def _bm25(docs: str, words: list[str], keep: str, prefix: bool) -> str:
    """BM25 over docs (id, t, and what keep reads), each word or prefix counted in every text anew."""
    same = "starts_with(x, w)" if prefix else "x = w"
    asked = ", ".join(f"('{w}')" for w in words)
    return f"""cut_ AS (SELECT *, regexp_extract_all(lower(coalesce(t, '')), '[\\p{{L}}\\p{{N}}]+') AS terms FROM {docs}), stats AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS mean FROM cut_),
hits AS (SELECT cut_.*, w, len(list_filter(terms, lambda x: {same})) AS tf FROM cut_, (VALUES {asked}) q(w)), dfs AS (SELECT w, count(*) FILTER (tf > 0) AS df FROM hits GROUP BY w),
scored AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / mean))) AS score FROM hits JOIN dfs USING (w), stats WHERE tf > 0 AND ({keep}) GROUP BY id)"""


ASKED = ["licens", "versio", "idio", "thor"]


@query(f"WITH {MEM}, docs AS (SELECT id, content AS t, scope, valid_from, valid_until FROM memories WHERE id % 23 <> 5), {_bm25('docs', ASKED, ALIVE + chr(32) + 'AND scope <> ' + chr(39) + 'project:web' + chr(39), True)} SELECT id, round(score, 6) AS score FROM scored ORDER BY score DESC, id LIMIT 60")
def indexed_memories_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories of a moment and of scopes by prefixes of words, from a kept index: some texts are changed and some deleted after it was first written."""
    m = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    index = _index(spark)
    attributes = memories(spark, sf_dir).select("id", "scope", "valid_from", "valid_until")
    index.add(m.withColumn("content", F.when(F.col("id") % 10 == 3, "an older text of no version").otherwise(F.col("content"))), 1, text_col="content", attributes=attributes)
    index.add(m.filter("id % 10 = 3"), 2, text_col="content", attributes=attributes)
    index.add(m.filter("id % 23 = 5"), 3, text_col="content", attributes=attributes, deleted=True)
    keep = temporal.active_at(F.lit(MOMENT).cast("timestamp")) & (F.col("scope") != "project:web")
    return index.search(ASKED, 60, prefix=True, keep=keep).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {BELIEFS}, docs AS (SELECT id, statement AS t, scope, status FROM beliefs), {_bm25('docs', ['stock', 'never', 'u7', 'ring'], chr(115) + 'tatus = ' + chr(39) + 'Active' + chr(39), False)} SELECT id, round(score, 6) AS score FROM scored ORDER BY score DESC, id LIMIT 40")
def indexed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active facts by words of their statements."""
    index = _index(spark)
    index.add(rec.beliefs(spark, sf_dir).select("id", "statement", "scope", "status"), 1, text_col="statement", attributes=["scope", "status"])
    return index.search(["stock", "never", "u7", "ring"], 40, keep=F.col("status") == "Active").select("id", F.round("score", 6).alias("score"))


@query(f"WITH docs AS (SELECT conv_id AS id, string_agg(text, ' ' ORDER BY turn, role) AS t FROM conversations GROUP BY conv_id), {_bm25('docs', ['the', 'die', 'version'], 'true', True)} SELECT id, round(score, 6) AS score FROM scored ORDER BY score DESC, id LIMIT 40")
def indexed_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as episodes by prefixes of their words."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: t["text"])
    c = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_join(turns, " ").alias("text"))
    index = _index(spark)
    index.add(c, 1)
    return index.search(["the", "die", "version"], 40, prefix=True).select("id", F.round("score", 6).alias("score"))


QUESTION = ["license", "version", "idiot", "thorin"]
FILE = "'src/f' || ({0} % 50) || '.rs'"


def _spread_sql(n: int) -> str:
    return f"""x{n} AS (SELECT e.dst AS node, sum(s.energy * e.weight * 0.65) AS got FROM s{n - 1} s JOIN ways e ON e.src = s.node WHERE s.energy >= 0.05 AND s.energy * e.weight * 0.65 >= 0.005 GROUP BY e.dst),
s{n} AS MATERIALIZED (SELECT coalesce(s.node, x.node) AS node, CASE WHEN x.got IS NULL THEN s.energy ELSE least(1.0, 0.2 * coalesce(s.energy, 0.0) + x.got) END AS energy FROM s{n - 1} s FULL JOIN x{n} x ON x.node = s.node)"""


def file_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, target): imports between files, from parts."""
    name = lambda k: F.concat(F.lit("src/f"), k % 50, F.lit(".rs"))
    return read(spark, sf_dir, "part").select(name(F.col("p_partkey")).alias("file"), name(F.col("p_partkey") * 3 + 1).alias("target")).distinct()


@query(
    f"""WITH {MEM}, alive AS (SELECT *, content AS t FROM memories WHERE {ALIVE} AND (branch IS NULL OR branch IN ('main', 'master', 'feature-a')) AND (scope IN ('project:web', 'project:books') OR scope = 'global')),
imports AS (SELECT DISTINCT {FILE.format('p_partkey')} AS f, {FILE.format('(p_partkey * 3 + 1)')} AS g FROM part), both_ AS (SELECT f, g FROM imports UNION SELECT g, f FROM imports),
hop1 AS (SELECT DISTINCT g AS f FROM both_ WHERE f = 'src/f7.rs' AND g <> 'src/f7.rs'), hop2 AS (SELECT DISTINCT b.g AS f FROM hop1 JOIN both_ b ON b.f = hop1.f WHERE b.g <> 'src/f7.rs' AND b.g NOT IN (SELECT f FROM hop1)),
hops AS (SELECT 'src/f7.rs' AS f, 1.5 AS factor UNION ALL SELECT f, 1.0 FROM hop1 UNION ALL SELECT f, 0.5 FROM hop2),
links AS (SELECT {FILE.format('id')} AS src, 'mem:' || id AS dst, 0.8::DOUBLE AS weight FROM memories UNION ALL SELECT f, g, 0.75::DOUBLE FROM imports UNION ALL SELECT 'tag:' || memory_type, 'mem:' || id, 0.5::DOUBLE FROM memories WHERE id % 5 = 1),
ways AS (SELECT src, dst, weight FROM links UNION ALL SELECT dst, src, weight * 0.85 FROM links), s0 AS (SELECT 'src/f7.rs' AS node, 0.9::DOUBLE AS energy UNION ALL SELECT 'tag:Semantic', 0.7::DOUBLE), {_spread_sql(1)}, {_spread_sql(2)}, {_spread_sql(3)},
{_bm25('(SELECT id, content AS t FROM memories)', QUESTION, 'true', False)}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
l1 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM scored JOIN alive USING (id)),
l2 AS (SELECT id, row_number() OVER (ORDER BY c DESC, id) AS r FROM (SELECT vec_id AS id, {COS} AS c FROM embeddings e, q) JOIN alive USING (id)),
l3 AS (SELECT a.id, row_number() OVER (ORDER BY energy DESC, a.id) AS r FROM s3 JOIN alive a ON node = 'mem:' || a.id),
u AS (SELECT id, 0.4 / (60 + r) AS p FROM l1 WHERE r <= 60 UNION ALL SELECT id, 0.4 / (60 + r) FROM l2 WHERE r <= 60 UNION ALL SELECT id, 0.35 / (60 + r) FROM l3 WHERE r <= 60), fused AS (SELECT id, sum(p) AS s FROM u GROUP BY id),
bad AS (SELECT user_id AS id FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id HAVING count(*) >= 3 AND count(*) FILTER (event_type = 'error') / count(*)::DOUBLE > 0.6),
final AS (SELECT a.id, (s * (0.8 + 0.4 * importance) * (0.5 + 0.5 * confidence) * (0.85 + 0.15 * CASE tier WHEN 'Core' THEN 1.0 WHEN 'Working' THEN 0.95 ELSE exp(-(epoch(TIMESTAMP '{MOMENT}' - valid_from) / 3600.0) / (24.0 * (1 + 0.2 * importance))) END)
  + coalesce(0.35 * factor, 0)) * CASE WHEN branch = 'feature-a' THEN 1.35 ELSE 1.0 END AS score FROM fused JOIN alive a USING (id) LEFT JOIN hops ON f = {FILE.format('a.id')} WHERE a.id NOT IN (SELECT id FROM bad))
SELECT id, round(score, 8) AS score FROM final ORDER BY score DESC, id LIMIT 25"""
)
def retrieve_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories of a moment, a branch and scopes by words, vectors and the graph, weighed by quality, recency and near files."""
    m = memories(spark, sf_dir)
    moment = F.lit(MOMENT).cast("timestamp")
    alive = m.drop("content").filter(temporal.active_at(moment) & temporal.branch_visible("feature-a") & temporal.in_scopes(["project:web", "project:books"]))
    name = lambda k: F.concat(F.lit("src/f"), k % 50, F.lit(".rs"))
    key, imports = F.concat(F.lit("mem:"), F.col("id")), file_imports(spark, sf_dir)
    edge = lambda df, src, dst, w: df.select(src.alias("src"), dst.alias("dst"), F.lit(w).alias("weight"))
    links = edge(m, name(F.col("id")), key, 0.8).unionByName(edge(imports, F.col("file"), F.col("target"), 0.75)).unionByName(edge(m.filter("id % 5 = 1"), F.concat(F.lit("tag:"), "memory_type"), key, 0.5))
    seeds = spark.createDataFrame([("src/f7.rs", 0.9), ("tag:Semantic", 0.7)], "node string, energy double")
    lit = graphs.diffuse(graphs.with_reverse(links), seeds).filter(F.col("node").startswith("mem:"))
    e = read(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))  # one row
    lists = {
        "words": (retrieval.bm25(m, QUESTION), search.WORDS),
        "vectors": (e.join(F.broadcast(q)).select(F.col("vec_id").alias("id"), retrieval.cosine(F.col("embedding"), F.col("q")).alias("score")), search.VECTORS),
        "graph": (lit.select(F.substring("node", 5, 40).cast("long").alias("id"), F.col("energy").alias("score")), search.GRAPH),
    }
    boost = search.hop_boost(m, m.select("id", name(F.col("id")).alias("file")), imports, ["src/f7.rs"])
    bad = evidence.efficacy(outcomes(spark, sf_dir)).filter("poisoned").select(F.col("memory_id").alias("id"))
    return search.retrieve_as_of(alive, lists, boost, bad, moment, "feature-a", 25).select("id", F.round("score", 8).alias("score"))
