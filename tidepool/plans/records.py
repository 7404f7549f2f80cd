"""Queries over facts, episodes, rules, signals, leases and statements, with their SQL; they join the catalogue of queries.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import errors, statements as st, temporal
from ..operators import graphs, upserts
from ..sources import records as rec
from ..sources.tables import memories, read
from .queries import DEPS, MEM, query

DAY = "TIMESTAMP '2024-01-01 00:00:00' + "
FACTS = f"""facts AS (SELECT p_partkey AS id, p_brand AS subject, split_part(p_type, ' ', 1) AS predicate, p_name AS object,
  CASE WHEN p_partkey % 5 = 0 THEN 'global' ELSE 'project:' || (p_partkey % 3) END AS scope, (p_partkey % 10) / 10.0::DOUBLE AS confidence, (p_partkey % 7) / 10.0::DOUBLE AS importance,
  (['Core','Working','Peripheral'])[p_partkey % 3 + 1] AS tier, {DAY} (p_partkey % 30) * INTERVAL 1 DAY AS valid_from,
  CASE WHEN p_size % 7 = 0 THEN {DAY} (p_partkey % 30 + 10) * INTERVAL 1 DAY END AS valid_until, 'src/f' || (p_partkey % 50) || '.rs' AS file,
  CASE WHEN p_partkey % 4 > 0 THEN 'c' || (p_partkey % 9) END AS commit_, CASE WHEN p_size % 11 = 0 THEN 'Deprecated' ELSE 'Active' END AS status, 'm' || (p_partkey % 2) AS model FROM part)"""
EPISODES = "episodes AS (SELECT o_orderkey AS id, o_custkey AS session_id, o_orderkey % 3 + 1 AS tier, CASE WHEN o_orderkey >= 8 THEN o_orderkey // 8 END AS parent, floor(epoch(o_orderdate))::BIGINT AS started, o_orderstatus AS outcome, o_totalprice AS size, o_orderpriority AS topic FROM orders)"
RULES = "versions AS (SELECT l_orderkey AS rule, l_linenumber AS version, max(l_suppkey) AS strength, bool_and(l_returnflag <> 'R') AS accepted FROM lineitem GROUP BY ALL)"
LEASES = "leases AS (SELECT l_partkey AS resource, l_orderkey AS holder, min(floor(epoch(l_shipdate))::BIGINT) AS at_, max(floor(epoch(l_shipdate))::BIGINT) + 864000 AS expires FROM lineitem GROUP BY ALL)"
MOMENT = "2024-01-20 00:00:00"
ALIVE = f"valid_from <= TIMESTAMP '{MOMENT}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{MOMENT}')"


def _moment() -> Column:
    return F.lit(MOMENT).cast("timestamp")


# Facts


@query(f"WITH {FACTS} SELECT id, subject, predicate, object FROM facts WHERE {ALIVE} AND status = 'Active'")
def facts_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.facts(spark, sf_dir).filter(temporal.active_at(_moment()) & (F.col("status") == "Active")).select("id", "subject", "predicate", "object")


@query(f"WITH {FACTS} SELECT id, scope, status, confidence FROM facts WHERE scope IN ('project:1', 'global')")
def facts_in_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.facts(spark, sf_dir).filter(temporal.in_scopes(["project:1"])).select("id", "scope", "status", "confidence")


@query(f"WITH {FACTS} SELECT model, count(*) AS facts, count(embedding) AS with_vector, count(DISTINCT len(embedding)) AS sizes FROM facts LEFT JOIN embeddings ON vec_id = id GROUP BY model")
def facts_with_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").alias("n"))
    return rec.facts(spark, sf_dir).join(e, "id", "left").groupBy("model").agg(F.count(F.lit(1)).alias("facts"), F.count("n").alias("with_vector"), F.count_distinct("n").alias("sizes"))


@query(f"WITH {FACTS} SELECT id, file, commit_ AS commit FROM facts WHERE (file = 'src/f7.rs' OR file LIKE '%/src/f7.rs') AND (commit_ IS NULL OR commit_ = 'c3')")
def facts_by_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts anchored in a file that hold at a commit; facts without one hold at all."""
    here = st.same_path_end(F.col("file"), F.lit("src/f7.rs")) & (F.col("commit").isNull() | (F.col("commit") == "c3"))
    return rec.facts(spark, sf_dir).filter(here).select("id", "file", "commit")


@query(
    f"""WITH {FACTS}, w AS (SELECT id, list_distinct(string_split(trim(regexp_replace(lower(subject || ' ' || object), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')) AS words FROM facts WHERE {ALIVE}),
s AS (SELECT id, len(list_intersect(words, ['brand', '1', '11', 'part', '7'])) AS matches FROM w) SELECT id, matches FROM s WHERE matches > 0 ORDER BY matches DESC, id LIMIT 40"""
)
def facts_search_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a moment by how many words of a query they have, the best forty."""
    words = F.array_distinct(F.split(st.normalised(F.concat_ws(" ", "subject", "object")), " "))
    found = rec.facts(spark, sf_dir).filter(temporal.active_at(_moment())).select("id", F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ("brand", "1", "11", "part", "7")]))).alias("matches"))
    return found.filter("matches > 0").orderBy(F.desc("matches"), "id").limit(40)


BEST = "(CASE tier WHEN 'Core' THEN 2 WHEN 'Working' THEN 1 ELSE 0 END, valid_from, confidence, importance, -id)"


@query(
    f"""WITH {FACTS}, a AS (SELECT * FROM facts WHERE status = 'Active'), w AS (SELECT scope, subject, predicate, arg_max(id, {BEST}) AS winner, count(*) AS n, count(DISTINCT object) AS objects FROM a GROUP BY ALL)
SELECT id, CASE WHEN id = winner THEN 'Active' ELSE 'Superseded' END AS status, winner, objects > 1 AS disputed FROM a JOIN w USING (scope, subject, predicate)"""
)
def belief_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of facts that say something about one subject and predicate in a scope, the strongest stands and the others are superseded by it: one aggregation, no pairs."""
    a = rec.facts(spark, sf_dir).filter("status = 'Active'")
    tier = F.when(F.col("tier") == "Core", 2).when(F.col("tier") == "Working", 1).otherwise(0)
    best = F.max_by("id", F.struct(tier.alias("t"), "valid_from", "confidence", "importance", (-F.col("id")).alias("i")))
    w = a.groupBy("scope", "subject", "predicate").agg(best.alias("winner"), F.count_distinct("object").alias("objects"))
    out = a.join(w, ["scope", "subject", "predicate"])
    return out.select("id", F.when(F.col("id") == F.col("winner"), "Active").otherwise("Superseded").alias("status"), "winner", (F.col("objects") > 1).alias("disputed"))


@query(f"WITH {FACTS} SELECT scope, subject, predicate, arg_max(object, (valid_from, id)) AS object, max(confidence) AS confidence, count(*) AS versions FROM facts GROUP BY scope, subject, predicate")
def fact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by key: the latest object, the highest confidence."""
    return rec.facts(spark, sf_dir).groupBy("scope", "subject", "predicate").agg(
        F.max_by("object", F.struct("valid_from", "id")).alias("object"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("versions")
    )


@query(f"WITH RECURSIVE {DEPS}, c AS (SELECT 100::BIGINT AS node, 0 AS depth UNION ALL SELECT d.dst, c.depth + 1 FROM c JOIN deps d ON d.src = c.node WHERE c.depth < 6) SELECT node, min(depth) AS depth FROM c WHERE depth > 0 GROUP BY node")
def upstream_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fact rests on, within six steps."""
    deps = read(spark, sf_dir, "lineitem").filter("l_orderkey > 1").select(F.expr("l_orderkey div 2").alias("src"), F.col("l_orderkey").alias("dst")).distinct()
    return graphs.dependents_closure(deps, spark.createDataFrame([(100,)], "node long"), 6)


@query(
    f"""WITH RECURSIVE {DEPS}, {FACTS}, c AS (SELECT id AS node, 0 AS depth, id AS cause FROM facts WHERE id IN (3, 5) UNION ALL SELECT d.src, c.depth + 1, c.cause FROM c JOIN deps d ON d.dst = c.node WHERE c.depth < 4),
h AS (SELECT node, min(depth) AS depth FROM c GROUP BY node) SELECT id, CASE WHEN depth = 0 THEN 'Retracted' WHEN depth > 0 THEN 'Invalidated' ELSE status END AS status, coalesce(depth, -1) AS depth FROM facts LEFT JOIN h ON node = id"""
)
def invalidation_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after two are retracted: what rests on them, within four steps, is invalid."""
    deps = read(spark, sf_dir, "lineitem").filter("l_orderkey > 1").select(F.col("l_orderkey").alias("src"), F.expr("l_orderkey div 2").alias("dst")).distinct()
    roots = spark.createDataFrame([(3,), (5,)], "node long")
    hit = graphs.dependents_closure(deps, roots, 4).unionByName(roots.withColumn("depth", F.lit(0))).withColumnRenamed("node", "id")
    f = rec.facts(spark, sf_dir).select("id", "status").join(hit, "id", "left")
    return f.select("id", F.when(F.col("depth") == 0, "Retracted").when(F.col("depth") > 0, "Invalidated").otherwise(F.col("status")).alias("status"), F.coalesce("depth", F.lit(-1)).alias("depth"))


@query(f"WITH {FACTS}, c AS (SELECT DISTINCT 'c' || (l_linenumber % 9) AS commit_ FROM lineitem) SELECT id, CASE WHEN commit_ IS NULL THEN 'kept' WHEN EXISTS (SELECT 1 FROM c WHERE c.commit_ = facts.commit_) THEN 'kept' ELSE 'closed' END AS state FROM facts")
def reconcile_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose commit is gone from the history are closed."""
    c = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), F.col("l_linenumber") % 9).alias("commit"), F.lit(True).alias("known")).distinct()
    f = rec.facts(spark, sf_dir).join(c, "commit", "left")
    return f.select("id", F.when(F.col("commit").isNull() | F.col("known"), "kept").otherwise("closed").alias("state"))


# Episodes and rules


@query(f"WITH {EPISODES} SELECT session_id, count(*) AS n, min(started) AS first, max(started) AS last, count(*) FILTER (outcome = 'F') AS finished FROM episodes GROUP BY session_id")
def episodes_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.episodes(spark, sf_dir).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("started").alias("first"), F.max("started").alias("last"), F.count_if(F.col("outcome") == "F").alias("finished"))


@query(f"WITH {EPISODES} SELECT id, session_id, started FROM episodes WHERE tier = 2 AND started <= epoch(TIMESTAMP '1996-01-01')::BIGINT")
def episodes_by_tier_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.episodes(spark, sf_dir).filter((F.col("tier") == 2) & (F.col("started") <= F.unix_timestamp(F.lit("1996-01-01").cast("timestamp")))).select("id", "session_id", "started")


@query(f"WITH {EPISODES} SELECT e.id, e.session_id FROM episodes e WHERE e.tier = 1 AND NOT EXISTS (SELECT 1 FROM episodes p WHERE p.id = e.parent AND p.tier = 2)")
def episodes_unrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-tier episodes that no second-tier one has taken up."""
    e = rec.episodes(spark, sf_dir)
    return e.filter("tier = 1").join(e.filter("tier = 2").select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "session_id")


@query(f"WITH {EPISODES} SELECT topic, tier, count(*) AS episodes, arg_min(id, (abs(size - m), id)) AS medoid FROM (SELECT *, avg(size) OVER (PARTITION BY topic, tier) AS m FROM (SELECT id, topic, tier, round(size)::BIGINT AS size FROM episodes)) GROUP BY topic, tier")
def consolidate_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of a topic and tier as one roll-up with the episode nearest to their mean size."""
    e = rec.episodes(spark, sf_dir).select("id", "topic", "tier", F.round("size").cast("long").alias("size"))
    mean = e.groupBy("topic", "tier").agg(F.avg("size").alias("m"), F.count(F.lit(1)).alias("episodes"))
    near = e.join(F.broadcast(mean), ["topic", "tier"])  # a row for each topic and tier, a few
    return near.groupBy("topic", "tier").agg(F.first("episodes").alias("episodes"), F.min_by("id", F.struct(F.abs(F.col("size") - F.col("m")).alias("d"), "id")).alias("medoid"))


@query(f"WITH {RULES} SELECT rule, max(version) AS version, arg_max(strength, version) AS strength, count(*) AS versions FROM versions GROUP BY rule")
def rules_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.rule_versions(spark, sf_dir).groupBy("rule").agg(F.max("version").alias("version"), F.max_by("strength", "version").alias("strength"), F.count(F.lit(1)).alias("versions"))


@query(f"WITH {RULES} SELECT rule, max(version) FILTER (accepted) AS version, arg_max(strength, version) FILTER (accepted) AS strength, max(version) > max(version) FILTER (accepted) AS rolled_back FROM versions GROUP BY rule HAVING bool_or(accepted)")
def rules_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules at their last accepted version."""
    ok = F.when(F.col("accepted"), F.col("version"))
    out = rec.rule_versions(spark, sf_dir).groupBy("rule").agg(F.max("version").alias("top"), F.max(ok).alias("version"), F.max_by("strength", ok).alias("strength"))
    return out.filter("version is not null").select("rule", "version", "strength", (F.col("top") > F.col("version")).alias("rolled_back"))


# Signals and preferences


@query("SELECT user_id AS memory_id, event_type AS kind, count(*) AS n, floor(epoch(max(ts)))::BIGINT AS last FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL")
def implicit_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rec.signals(spark, sf_dir).filter(F.col("kind").isin("click", "view"))
    return s.groupBy("memory_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))


@query("SELECT user_id AS memory_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + 0.05::DOUBLE * count(*) FILTER (event_type = 'purchase') - 0.1::DOUBLE * count(*) FILTER (event_type = 'error'))), 6) AS confidence, count(*) AS n FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id")
def feedback_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence after feedback: a step up for each success, two steps down for each failure, between 0 and 1."""
    good, bad = F.count_if(F.col("kind") == "purchase"), F.count_if(F.col("kind") == "error")
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.05) * good - F.lit(0.1) * bad))
    return rec.signals(spark, sf_dir).filter(F.col("kind").isin("purchase", "error")).groupBy("memory_id").agg(F.round(value, 6).alias("confidence"), F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT user_id AS memory_id, arg_max(event_id, (value, event_id)) AS chosen, arg_min(event_id, (value, event_id)) AS rejected, max(value) - min(value) AS margin FROM events GROUP BY user_id) SELECT memory_id, chosen, rejected, round(margin, 6) AS margin FROM s WHERE margin > 0.1")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best and the worst answer of each prompt, where they are clearly apart."""
    key = F.struct("value", "id")
    s = rec.signals(spark, sf_dir).groupBy("memory_id").agg(F.max_by("id", key).alias("chosen"), F.min_by("id", key).alias("rejected"), (F.max("value") - F.min("value")).alias("margin"))
    return s.filter("margin > 0.1").select("memory_id", "chosen", "rejected", F.round("margin", 6).alias("margin"))


@query(f"WITH {MEM}, u AS (SELECT user_id AS id, count(*) AS n, floor(epoch(max(ts)))::BIGINT AS last FROM events GROUP BY 1) SELECT m.id, coalesce(n, 0) AS accesses, last FROM memories m LEFT JOIN u USING (id)")
def access_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = rec.signals(spark, sf_dir).groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    return memories(spark, sf_dir).select("id").join(u, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("accesses"), "last")


@query(f"WITH {MEM}, g AS (SELECT user_id AS id, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1) SELECT id, tier AS before, CASE WHEN tier <> 'Core' AND ok >= 3 AND ok > 2 * bad THEN 'Core' ELSE tier END AS tier FROM memories LEFT JOIN g USING (id)")
def promote_to_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that have served three times or more, and twice as often as they failed, become core."""
    g = rec.signals(spark, sf_dir).groupBy(F.col("memory_id").alias("id")).agg(F.count_if(F.col("kind") == "purchase").alias("ok"), F.count_if(F.col("kind") == "error").alias("bad"))
    up = (F.col("tier") != "Core") & (F.col("ok") >= 3) & (F.col("ok") > 2 * F.col("bad"))
    return memories(spark, sf_dir).join(g, "id", "left").select("id", F.col("tier").alias("before"), F.when(up, "Core").otherwise(F.col("tier")).alias("tier"))


# Leases, changes, authorities


@query(f"WITH {LEASES} SELECT resource, holder, expires - epoch(TIMESTAMP '1996-01-01')::BIGINT AS remaining FROM leases WHERE at_ <= epoch(TIMESTAMP '1996-01-01')::BIGINT AND expires > epoch(TIMESTAMP '1996-01-01')::BIGINT")
def leases_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.unix_timestamp(F.lit("1996-01-01").cast("timestamp"))
    return rec.leases(spark, sf_dir).filter((F.col("at") <= now) & (F.col("expires") > now)).select("resource", "holder", (F.col("expires") - now).alias("remaining"))


@query(f"WITH {LEASES} SELECT resource, count(*) FILTER (expires <= epoch(TIMESTAMP '1996-01-01')::BIGINT) AS pruned, count(*) FILTER (expires > epoch(TIMESTAMP '1996-01-01')::BIGINT) AS kept FROM leases GROUP BY resource")
def leases_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, gone = upserts.split(rec.leases(spark, sf_dir), F.col("expires") <= F.unix_timestamp(F.lit("1996-01-01").cast("timestamp")))
    both = kept.select("resource", F.lit(0).alias("gone")).unionByName(gone.select("resource", F.lit(1).alias("gone")))
    return both.groupBy("resource").agg(F.count_if(F.col("gone") == 1).alias("pruned"), F.count_if(F.col("gone") == 0).alias("kept"))


@query("SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN (event_id % 12 + 1)::INT ELSE (event_id % 12)::INT END AS retries, event_type = 'purchase' AS synced, CASE WHEN event_type = 'error' THEN floor(epoch(ts))::BIGINT + least(300.0, 2.0 ** (event_id % 12))::BIGINT END AS next_try FROM events")
def delta_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox rows after a push: purchases are synced, errors are tried again later and later."""
    failed, before = F.col("event_type") == "error", (F.col("event_id") % 12).cast("int")
    wait = errors.backoff_seconds(before + 1).cast("long")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.when(failed, before + 1).otherwise(before).alias("retries"), (F.col("event_type") == "purchase").alias("synced"),
        F.when(failed, F.unix_timestamp("ts") + wait).alias("next_try"),
    )


@query("SELECT c_mktsegment AS domain, arg_max(c_custkey, ((c_custkey % 10) / 10.0::DOUBLE, -(c_custkey % 4), -c_custkey)) AS agent, max((c_custkey % 10) / 10.0::DOUBLE) AS confidence, count(*) AS agents FROM customer GROUP BY 1")
def best_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each domain the agent of the highest confidence, the least load, the smallest id."""
    order = F.struct("confidence", (-F.col("load")).alias("l"), (-F.col("agent")).alias("a"))
    return rec.agents(spark, sf_dir).groupBy("domain").agg(F.max_by("agent", order).alias("agent"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("agents"))


# Statements


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _norm(t: str) -> str:
    return f"trim(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _meaningful(t: str) -> str:
    return f"list_distinct(list_filter(string_split({_norm(t)}, ' '), lambda w: strlen(w) >= 2 AND NOT list_contains({_list(st.STOP_WORDS)}, w)))"


def _canonical(t: str) -> str:
    words = f"list_filter(string_split({_norm(t)}, ' '), lambda w: w <> '')"
    kept = f"list_filter({words}, lambda w: NOT list_contains({_list(st.ARTICLES)}, w))"
    return f"array_to_string(CASE WHEN len({kept}) = 0 THEN {words} ELSE {kept} END, ' ')"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


TURNS = "turns AS (SELECT conv_id, turn, text AS b, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS a FROM conversations)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement of a conversation with the one before it."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("b"), F.lag("text").over(w).alias("a")).filter("a is not null and b is not null")


@query(f"WITH {TURNS}, s AS (SELECT conv_id, turn, {_meaningful('a')} AS x, {_meaningful('b')} AS y FROM turns WHERE a IS NOT NULL AND b IS NOT NULL) SELECT conv_id, turn, round({_jaccard('x', 'y')}, 6) AS jaccard, len(list_intersect(x, y)) >= 2 OR (len(list_intersect(x, y)) >= 1 AND (len(x) <= 3 OR len(y) <= 3)) AS same_topic FROM s")
def statement_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    t = _turns(spark, sf_dir).select("conv_id", "turn", st.meaningful_words(F.col("a")).alias("x"), st.meaningful_words(F.col("b")).alias("y"))
    return t.select("conv_id", "turn", F.round(st.word_jaccard(x, y), 6).alias("jaccard"), st.same_topic(x, y).alias("same_topic"))


def _value_changed() -> str:
    parts = []
    for sep in st.SEPARATORS:
        at = lambda t: f"instr({t}, '{sep}')"  # noqa: B023, E731
        head, tail = (lambda t: f"left({t}, {at(t)} - 1)"), (lambda t: f"substr({t}, {at(t)} + {len(sep)})")  # noqa: B023, E731
        parts.append(f"({at('cx')} > 0 AND {at('cy')} > 0 AND {head('cx')} = {head('cy')} AND contains({head('cx')}, ' ') AND {_jaccard(_meaningful(tail('cx')), _meaningful(tail('cy')))} < 0.5)")
    return "(cx <> cy AND (" + " OR ".join(parts) + "))"


_RETRACT = "regexp_matches(lower(trim(b)), '^(" + "|".join(st.RETRACT_PREFIXES) + "):') OR " + " OR ".join(f"contains(lower(trim(b)), '{c}')" for c in st.RETRACT_CUES)
_NUMBERS = "list_filter(string_split({0}, ' '), lambda w: regexp_matches(w, '[0-9]'))"
_STRIPPED = "trim(regexp_replace(regexp_replace(trim(b), '^(" + "|".join(st.RETRACT_PREFIXES) + "|remove rule|drop requirement):\\s*', '', 'i'), ' (is no longer valid|is no longer applicable|is obsolete|is removed|has been removed)$', '', 'i'))"


@query(
    f"""WITH {TURNS}, n AS (SELECT conv_id, turn, {_norm('a')} AS nx, {_norm('b')} AS ny, {_canonical('a')} AS cx, {_canonical('b')} AS cy, {_meaningful('a')} AS wx, {_meaningful(_STRIPPED)} AS wy, {_RETRACT} AS retracts FROM turns WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT conv_id, turn, CASE WHEN retracts AND (len(list_intersect(wx, wy)) >= 2 OR (len(list_intersect(wx, wy)) >= 1 AND (len(wx) <= 3 OR len(wy) <= 3))) THEN 'delete' WHEN cx = cy THEN 'noop'
WHEN (nx <> ny AND len({_NUMBERS.format('nx')}) > 0 AND len({_NUMBERS.format('ny')}) > 0 AND {_NUMBERS.format('nx')} <> {_NUMBERS.format('ny')} AND regexp_replace(nx, '[0-9]+', '#', 'g') = regexp_replace(ny, '[0-9]+', '#', 'g') AND strlen(regexp_replace(nx, '[0-9]+', '#', 'g')) >= 5)
 OR {_value_changed()} THEN 'update' ELSE 'add' END AS decision FROM n"""
)
def statement_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each statement adds to, repeats, updates or retracts the one before it."""
    return _turns(spark, sf_dir).select("conv_id", "turn", st.decision(F.col("a"), F.col("b")).alias("decision"))


SLOTS = 8


@query(
    f"""WITH t AS (SELECT conv_id, turn, role, list_filter(string_split({_canonical('text')}, ' '), lambda w: w <> '') AS w FROM conversations WHERE text IS NOT NULL),
u AS (SELECT conv_id, turn, role, unnest(range({SLOTS})) AS slot, w FROM t), m AS (SELECT conv_id, turn, role, slot, list_min(list_transform(w, lambda x: md5(slot || ':' || x))) AS v FROM u)
SELECT slot, v AS value, count(*) AS n FROM m WHERE v IS NOT NULL GROUP BY slot, v HAVING count(*) > 1"""
)
def minhash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash values that several statements share: where near copies meet."""
    c = read(spark, sf_dir, "conversations").filter("text is not null").select(st.canonical_words(F.col("text")).alias("w"))
    c = c.select(F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"), "w")
    lowest = F.array_min(F.expr("transform(w, x -> md5(concat(slot, ':', x)))"))
    out = c.select(F.col("slot").cast("long").alias("slot"), lowest.alias("value")).filter("value is not null")
    return out.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '\\\\', '/', 'g'), '^[a-z]+:/+', ''), '/+', '/', 'g'), '^(\\./)+', '') AS path FROM pages")
def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", st.normal_path(F.col("url")).alias("path"))


@query("""SELECT conv_id, turn, role, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_-]+'), lambda w: '"' || w || '"*'), ' OR ') AS query, ceil(length(text) / 4.0)::BIGINT AS tokens FROM conversations WHERE text IS NOT NULL""")
def match_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").filter("text is not null")
    return c.select("conv_id", "turn", "role", st.match_query(F.col("text")).alias("query"), st.token_estimate(F.col("text")).alias("tokens"))
