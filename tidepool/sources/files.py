"""File sinks and sources of training samples, change logs and logs of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SAMPLES = {
    "dpo": "prompt string, chosen string, rejected string, verified boolean",
    "kto": "prompt string, completion string, label boolean, verified boolean",
    "sft": "instruction string, input string, output string, verified boolean",
}


def export_samples(samples: DataFrame, path: str, require_verified: bool = False) -> None:
    """Write samples as JSON lines; with require_verified only verified ones."""
    rows = samples.filter("verified") if require_verified else samples
    rows.write.mode("overwrite").json(path)


def read_samples(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(SAMPLES[kind]).json(path)


def export_markdown(samples: DataFrame, path: str, title: str, body: str) -> None:
    """Write one Markdown section for each row."""
    samples.select(F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.col(body), F.lit("\n"))).write.mode("overwrite").text(path)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """(file, error class, line) of compiler and test logs, one row for each error line."""
    lines = spark.read.text(path).select(F.col("value"), F.input_file_name().alias("log"))
    kind = F.regexp_extract("value", r"(?:^|\s)(error(?:\[[A-Z]?\d+\])?|[A-Z]\w*Error|panicked)", 1)
    place = F.regexp_extract("value", r"([\w./-]+\.\w+):(\d+)", 1)
    return lines.select("log", kind.alias("error_class"), place.alias("file"), F.expr("try_cast(regexp_extract(value, '([\\\\w./-]+\\\\.\\\\w+):(\\\\d+)', 2) as int)").alias("line")).filter("error_class <> ''")


def pending_changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A change log as a stream, in files that only grow by new ones."""
    return spark.readStream.schema(schema).json(path)
