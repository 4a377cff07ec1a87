"""What the operators share: working folders, written tables and column guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.sources.scratch import remove, scratch, scratch_table

#: White space and word patterns of the text operators (ASCII only).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a batch of rows for Python.
BATCH_BYTES = 8 << 20

#: Bytes that one reduce task of a packed shuffle is meant to hold; more input gets more buckets.
BUCKET_BYTES = 128 << 20


def saved(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there."""
    return reread(df.sparkSession, save(df, name, partition_by), df)


def save(df: DataFrame, name: str, partition_by: str | None = None) -> str:
    path = scratch(df.sparkSession, name)
    w = df.write
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return path


def bucketed(df: DataFrame, name: str, buckets: int, key: str) -> tuple[str, str]:
    """``df`` as a table bucketed and sorted by ``key``: its name and the path of its files."""
    table, path = scratch_table(df.sparkSession, name)
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return table, path


def forget(df: DataFrame) -> None:
    """Remove the files of a saved table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def reread(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Batches between the JVM and Python of a few megabytes, however long the texts: both sides
    hold some at once, and the JVM keeps what it once took for them. A setting of the session: plans
    that run later, when their results are asked for, need it too, so it is lowered and stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if not (now and now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, size: int) -> int:
    """Buckets for a packed shuffle of about ``size`` bytes."""
    return max(partitions(spark), -(-size // BUCKET_BYTES))


def n_words(c: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")
