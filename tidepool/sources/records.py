"""Frames of facts, episodes, skills, signals, leases and the like, built from the analytic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import dealt
from .tables import read


def _day(offset: str) -> Column:
    return F.expr(f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast({offset} as int))")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, predicate and object with validity, anchor and commit, from parts."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_brand").alias("subject"), F.substring_index("p_type", " ", 1).alias("predicate"), F.col("p_name").alias("object"),
        F.when(k % 5 == 0, "global").otherwise(F.concat(F.lit("project:"), k % 3)).alias("scope"), (k % 10 / F.lit(10.0)).alias("confidence"),
        (k % 7 / F.lit(10.0)).alias("importance"), F.get(F.array(F.lit("Core"), F.lit("Working"), F.lit("Peripheral")), (k % 3).cast("int")).alias("tier"),
        _day("p_partkey % 30").alias("valid_from"), F.when(F.col("p_size") % 7 == 0, _day("p_partkey % 30 + 10")).alias("valid_until"),
        F.concat(F.lit("src/f"), k % 50, F.lit(".rs")).alias("file"), F.when(k % 4 > 0, F.concat(F.lit("c"), k % 9)).alias("commit"),
        F.when(F.col("p_size") % 11 == 0, "Deprecated").otherwise("Active").alias("status"), F.concat(F.lit("m"), k % 2).alias("model"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of three tiers with parents, from orders."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("session_id"), (k % 3 + 1).alias("tier"), F.when(k >= 8, F.expr("o_orderkey div 8")).alias("parent"),
        F.unix_timestamp("o_orderdate").alias("started"), F.col("o_orderstatus").alias("outcome"), F.col("o_totalprice").alias("size"), F.col("o_orderpriority").alias("topic"),
    )


def rule_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule, version, strength, accepted): versions of procedural rules, from line items."""
    l = read(spark, sf_dir, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("rule"), F.col("l_linenumber").alias("version")).agg(
        F.max("l_suppkey").alias("strength"), F.bool_and(F.col("l_returnflag") != "R").alias("accepted")
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, memory_id, kind, value, at) of implicit signals and feedback, from events."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("memory_id"), F.col("event_type").alias("kind"), "value", F.unix_timestamp("ts").alias("at")
    )


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resource, holder, at, expires): claims on resources in seconds, from line items; a claim lasts ten days."""
    at = F.unix_timestamp("l_shipdate")
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("resource"), F.col("l_orderkey").alias("holder")).agg(
        F.min(at).alias("at"), (F.max(at) + 864_000).alias("expires")
    )


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(agent, domain, confidence, load): what agents know about domains, from customers."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("agent"), F.col("c_mktsegment").alias("domain"), (F.col("c_custkey") % 10 / F.lit(10.0)).alias("confidence"), (F.col("c_custkey") % 4).alias("load"))


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with what arbitration and truth maintenance need, from parts: twenty neighbouring parts speak of one unit and bay.

    Every fifth is new; the others stand, but for those that are deprecated or suspicious.
    """
    k = F.col("p_partkey")
    says = F.get(F.array(*[F.lit(x) for x in BELIEF_CLAIMS]), (k % len(BELIEF_CLAIMS)).cast("int"))
    unit = F.expr("p_partkey div 20")
    return read(spark, sf_dir, "part").select(
        k.alias("id"), F.concat(F.lit("Unit u"), unit, F.lit(" bay b"), unit, F.lit(": "), "p_name", F.lit(" "), says).alias("statement"),
        F.when(k % 7 == 0, "global").otherwise(F.concat(F.lit("project:"), F.expr("p_partkey div 200 % 3"))).alias("scope"),
        F.get(F.array(F.lit("Core"), F.lit("Working"), F.lit("Peripheral"), F.lit("Peripheral")), (F.col("p_size") % 4).cast("int")).alias("tier"),
        (k % 29 == 0).alias("approved"), _day("p_partkey % 4").alias("created_at"), (k % 13 / F.lit(100.0) + F.lit(0.5)).alias("confidence"), (k % 31 / F.lit(100.0) + F.lit(0.3)).alias("importance"),
        F.when(F.col("p_size") % 11 == 0, "Deprecated").when(F.col("p_size") % 13 == 0, "Suspicious").otherwise("Active").alias("status"), (k % 3 + 1).cast("int").alias("version"), (k % 5 == 2).alias("new"),
    )


BELIEF_CLAIMS = ["is always in stock", "is never in stock", "must ship in boxes", "must not ship in boxes", "switched to bulk, replaced by pallets"]


def notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(active, new) statements (id, text, scope), from parts: each names its own unit and a limit.

    Every fifth is new and says of the part before it: the same in capitals,
    another limit, that it no longer holds, another limit in other words, or
    it says something of its own.
    """
    k = F.col("p_partkey")
    part = read(spark, sf_dir, "part").select(k, "p_name", "p_size", F.when(F.expr("p_partkey div 5 % 7 = 0"), "global").otherwise(F.concat(F.lit("project:"), F.expr("p_partkey div 5 % 3"))).alias("scope"))
    says = lambda name, key, size: F.concat(F.lit("Unit u"), key, F.lit(" bay: the "), name, F.lit(" limit is "), size)
    old = says(F.col("p_name"), k, F.col("p_size"))
    active = part.filter("p_partkey % 5 <> 2").select(k.alias("id"), old.alias("text"), "scope")
    before = part.filter("p_partkey % 5 = 1").select((k + 1).alias("p_partkey"), old.alias("said"), says(F.col("p_name"), k, F.col("p_size") + 100).alias("raised"))
    fresh = part.filter("p_partkey % 5 = 2").join(before, "p_partkey")
    way = F.expr("p_partkey div 5 % 5")
    text = (
        F.when(way == 0, F.concat(F.upper("said"), F.lit("!"))).when(way == 1, F.col("raised")).when(way == 2, F.concat(F.lit("Retract: "), F.col("said")))
        .when(way == 3, F.concat(F.col("said"), F.lit(" and must not grow, deprecated"))).otherwise(F.concat(F.lit("Every "), F.col("p_name"), F.lit(" of the new plant has the number "), k))
    )
    return active, fresh.select(k.alias("id"), text.alias("text"), "scope")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resource, holder, at, ttl, release): claims on leases and releases in seconds, from line items."""
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 0)
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("resource"), (F.col("l_partkey") % 7).alias("holder"), F.unix_timestamp("l_shipdate").alias("at"), (F.col("l_linenumber") * 86_400).cast("long").alias("ttl"), returned.alias("release")
    )


def edge_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind, at, seq, positive, score): feedback on edges, from events."""
    k = F.col("event_id")
    kind = F.get(F.array(F.lit("Supports"), F.lit("MentionsFile"), F.lit("SharedTag")), (k % 3).cast("int"))
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("mem:"), F.col("user_id")).alias("src"), F.concat(F.lit("tag:"), k % 5).alias("dst"), kind.alias("kind"), F.unix_timestamp("ts").alias("at"), k.alias("seq"),
        F.col("event_type").isin("purchase", "click").alias("positive"), (k % 12 / F.lit(10.0)).alias("score"),
    )


def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind, weight) in both directions between parts and suppliers, from line items."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    pairs = dealt(read(spark, sf_dir, "lineitem").select(p, s), "l_partkey", "l_suppkey").distinct()
    one = pairs.select(
        F.concat(F.lit("mem:"), p).alias("src"), F.concat(F.lit("fact:"), s).alias("dst"), F.when((p + s) % 3 == 0, "Supports").otherwise("SharedTag").alias("kind"), ((p * 7 + s * 3) % 40 / F.lit(100.0) + F.lit(0.55)).alias("weight")
    )
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", (F.col("weight") * F.lit(0.85)).alias("weight")))


def call_sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, imports, symbols): calls of symbols from files, bindings of imports, and definitions, from line items, orders and parts. Some paths have backslashes."""
    file = lambda k, slash: F.concat(F.lit("src"), slash, F.lit("m"), k % 12, slash, F.lit("f"), k % 60, F.lit(".rs"))
    l, p, o = F.col("l_partkey"), F.col("p_partkey"), F.col("o_orderkey")
    name = F.concat(F.lit("s"), (l * 3 + F.col("l_suppkey")) % 300)
    way = F.col("l_linenumber") % 4
    callee = F.when(way == 0, F.concat(name, F.lit("::new"))).when(way == 1, F.concat(name, F.lit(".run"))).otherwise(name)
    edges = read(spark, sf_dir, "lineitem").select(F.when(l % 2 == 0, file(l, F.lit("/"))).otherwise(file(l, F.lit("\\"))).alias("caller_file"), callee.alias("callee")).distinct()
    imports = read(spark, sf_dir, "orders").select(file(o, F.lit("/")).alias("file"), F.concat(F.lit("s"), o % 90).alias("symbol"), F.concat(F.lit("src/lib/l"), o % 17, F.lit(".rs")).alias("target"))
    symbols = read(spark, sf_dir, "part").select(file(p, F.lit("/")).alias("file"), F.concat(F.lit("s"), F.expr("p_partkey * 7 % 260")).alias("symbol"))
    return edges, imports, symbols
