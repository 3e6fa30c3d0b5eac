"""Session settings, the shared work folder, and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join input even when a later operator then needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Long texts count by bytes: what a Python worker holds at once must not grow with a row's size.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


# Plans over the ledger keep a sum for nearly every row: some twenty times what a task reads from a shuffle. Shuffles start in many
# parts, which are merged to this size, so a task's memory stays the same however long the log is.
LEDGER_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # What a task writes to a shuffle of many parts is sorted in memory.
    "spark.sql.files.maxPartitionBytes": "32m",
}


#: Whether a query's shuffle files go once it is through; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that are shuffled at once, about, where a step can be done for some keys after others.
PART_ROWS = 30_000_000


def configure(spark: SparkSession, **more: str) -> SparkSession:
    """Apply the runtime settings every plan relies on, and ``more``."""
    for name, value in (SETTINGS | more).items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; only a local session may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tickerloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder. One application's paths lie together, to be deleted after it ends."""
    return f"{shared_dir(spark)}/tickerloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; the written table, and its path for :func:`discard`.

    Later jobs neither repeat the work nor depend on executors that may be lost.
    """
    return staged_parts([df], name)


def staged_parts(frames: list[DataFrame], name: str) -> tuple[DataFrame, str]:
    """As :func:`staged`, for the rows of all frames. They are written one after another, and what one shuffled is gone before the next."""
    spark = frames[0].sparkSession
    path, before = work_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        for df in frames:
            df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    return spark.read.schema(frames[0].schema).parquet(path), path


def in_parts(rows: int, *keys: str) -> list[Column]:
    """Conditions that each hold for the keys of some ``PART_ROWS`` of so many rows, every key for one of them."""
    parts = max(1, -(-rows // PART_ROWS))
    return [F.pmod(F.xxhash64(*keys), F.lit(parts)) == i for i in range(parts)] if parts > 1 else [F.lit(True)]


def stage(df: DataFrame, name: str) -> DataFrame:
    """As :func:`staged`, for tables that results go on reading."""
    return staged(df, name)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
