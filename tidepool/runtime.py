"""The session's side of the engine: modules for the Python workers, lineage cuts, joins that a frequent key doesn't slow down."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="tidepool-"), "tidepool.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent).as_posix())
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark


#: Shuffle files go when the write that made them ends; else they lie on disk until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session, whose tasks run in the driver, may leave it unset; it gets one of its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tidepool-rounds-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: what follows survives the loss of executors, and an iteration's plan doesn't hold all earlier rounds. The shuffle files of df are deleted."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidepool-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def together(*tables: DataFrame) -> DataFrame:
    """Tables of one schema that cut wrote, as one: a single scan of all their folders, so that the plan of what follows doesn't grow with their number."""
    spark, files = tables[0].sparkSession, [name for df in tables for name in df.inputFiles()]
    return spark.read.schema(tables[0].schema).parquet(*dict.fromkeys(name.rsplit("/", 1)[0] for name in files))


#: Keys with more than one row in so many are joined by broadcast; there are HOT of them at most.
HOT = 1000


def look_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of rows, a written table, to a table of one row a key, where one key may hold any share of the rows.

    Keys of more than a HOT-th of the rows are joined by broadcast, all others by shuffle.
    """
    total = rows.count()
    hot = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") * HOT > total).select(key))
    known = table.join(F.broadcast(hot), key)  # HOT rows at most
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(known), key).unionByName(rest)


#: A written table of at most so many rows may be sent to every task.
FEW = 100_000


def few(table: DataFrame) -> DataFrame:
    """table, a written one, marked for broadcast if it is small: a join to it then reads the other side as a stream, without a shuffle."""
    return F.broadcast(table) if table.count() <= FEW else table


def joinable(table: DataFrame) -> DataFrame:
    """few, but a larger table is never broadcast: the planner goes by bytes of compressed files, of which ten million hold more keys than a driver may hold."""
    return F.broadcast(table) if table.count() <= FEW else table.hint("merge")


#: Rows that one task sorts or aggregates, about.
ROWS_A_TASK = 1_000_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt by its keys to as many tasks as its rows need, so that a task holds no more where the input grows. rows is their number, if counting df would compute it."""
    each = -(-(df.count() if rows is None else rows) // ROWS_A_TASK)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, each), *keys)
