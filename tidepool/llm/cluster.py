"""Lineage cuts and partition counts, taken from the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Keys that hold more than one part in so many of a table are joined by broadcast.
HOT = 200

#: Shuffle files go when the write that made them ends; else they lie on disk until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of an Arrow batch, of which a Python worker holds two and an executor's JVM some outside of its heap, for each task.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset, as in local tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="tidepool-shared-")
    return _own_folder[context.applicationId]


def cut(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The table survives the loss of executors, and its true size is known to
    the planner, which a checkpoint of a join doesn't give it. The shuffle
    files of df are deleted. Rows go to Python and back in batches of about
    batch_bytes, if given.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidepool-{uuid.uuid4().hex}"
    wanted = {CLEANUP: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that cut wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """How many pieces keyed work is dealt into at least: the session's shuffle partitions."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pieces(spark: SparkSession, size: int, each: int) -> int:
    """How many pieces of about `each` a table of `size` makes, the session's shuffle partitions at least."""
    return max(partitions(spark), -(-size // each))


def spread(df: DataFrame, each: int = 1 << 23) -> DataFrame:
    """df with its rows over all cores, if it is a small file: those often have one row group, which one task would read.

    From `each` bytes a core on, files have row groups enough, and nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < each * cores else df


def look_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of rows to a table of one row a key, where a key may hold any share of the rows.

    Keys of more than a HOT-th of the rows, HOT at most, are joined by
    broadcast, the others by shuffle. rows is read three times, so pass a
    written table.
    """
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > total / HOT).select(key)
    hot = cut(table.join(F.broadcast(hot), key))  # HOT rows at most
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
