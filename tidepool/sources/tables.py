"""Reads the analytic tables and builds the engine's canonical frames from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The moment that all queries take as "now": nothing reads the clock.
NOW = "2024-02-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory records from documents and their labels.

    Validity starts doc_id mod 30 days into 2024; toxic rows end after ten
    days. Every seventh row belongs to the global scope, branches and tiers go
    round. importance and confidence are multiples of 0.1.
    """
    docs = read(spark, sf_dir, "documents").drop("n_chars")
    labels = read(spark, sf_dir, "labels")
    day = lambda extra: F.expr(f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 30 + {extra} as int))")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 7 == 0, "global").otherwise(F.concat(F.lit("project:"), F.col("source"))).alias("scope"),
        F.when(F.col("lang") == "en", "Semantic").when(F.col("lang") == "de", "Episodic").when(F.col("lang") == "fr", "Procedural").otherwise("NegativePattern").alias("memory_type"),
        F.get(F.array(F.lit("Core"), F.lit("Working"), F.lit("Peripheral"), F.lit("Peripheral")), (F.col("doc_id") % 4).cast("int")).alias("tier"),
        (F.col("doc_id") % 11 / F.lit(10.0)).alias("importance"),
        (F.when(F.col("quality") == 0, F.lit(3.0)).otherwise(F.lit(8.0)) / F.lit(10.0)).alias("confidence"),
        day(0).alias("valid_from"),
        F.when(F.col("toxic") == 1, day(10)).alias("valid_until"),
        F.get(F.array(F.lit("main"), F.lit("feature-a"), F.lit("feature-b"), F.lit(None).cast("string")), (F.col("doc_id") % 4).cast("int")).alias("branch"),
        F.when(F.col("toxic") == 1, "Deprecated").otherwise("Active").alias("status"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log by session: a user is a session, its events are numbered in time order."""
    kind = (
        F.when(F.col("event_type") == "error", "ErrorObserved")
        .when(F.col("event_type") == "purchase", "TaskCompleted")
        .when(F.col("event_type") == "view", "ObservationReceived")
        .when(F.col("event_type") == "click", "ToolInvoked")
        .otherwise("SessionStarted")
    )
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "ts", kind.alias("event_type"), "value", "props"
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injection outcomes from events: errors are failures, purchases successes."""
    rows = read(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase"))
    return rows.select(
        F.col("user_id").alias("memory_id"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"), "ts"
    )


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to supplier edges (src, dst, weight) with node keys, from line items."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("mem:"), F.col("l_partkey")).alias("src"), F.concat(F.lit("fact:"), F.col("l_suppkey")).alias("dst"), "n"
    )
