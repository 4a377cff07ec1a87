"""Text and delimited files, sequences, collections and byte records; the sinks that go with them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field delimiter of the delimited files.
DELIMITER = "|"


def read_delimited(spark: SparkSession, path: str | list[str], schema: str, sep: str = DELIMITER) -> DataFrame:
    """Rows with a fixed schema; a field that does not parse is null and the row stays."""
    return spark.read.schema(schema).option("sep", sep).option("mode", "PERMISSIVE").csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = DELIMITER, mode: str = "error") -> None:
    df.write.mode(mode).option("sep", sep).csv(path)


def parse_delimited(line: Column, schema: str, sep: str = DELIMITER) -> Column:
    """The same parse for a column of lines."""
    return F.from_csv(line, schema, {"sep": sep, "mode": "PERMISSIVE"})


def read_text(spark: SparkSession, *paths: str) -> DataFrame:
    """The lines of one or more text inputs in a column ``value``."""
    return spark.read.text(list(paths))


def write_text(df: DataFrame, path: str) -> None:
    """Rows as lines ``(a,b,...)``, replacing what is there."""
    line = F.concat(F.lit("("), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(")"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def discard(df: DataFrame) -> None:
    """Run the plan and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def sequence(spark: SparkSession, lo: int, hi: int, col: str = "id") -> DataFrame:
    """The whole numbers from ``lo`` to ``hi``, both included."""
    return spark.range(lo, hi + 1).withColumnRenamed("id", col)


def collection(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def byte_records(spark: SparkSession, sources: int, records: int, distinct: int, size: int = 1024) -> DataFrame:
    """``records`` records of ``size`` bytes for each source, cycling through ``distinct`` ones;
    the bytes follow from the record's number, so reruns agree."""
    blocks = -(-size // 32)
    base = spark.range(sources * records).select((F.col("id") / records).cast("long").alias("source"), (F.col("id") % records % distinct).alias("n"))
    hexed = F.concat(*[F.sha2(F.concat_ws("-", F.col("n").cast("string"), F.lit(str(k))), 256) for k in range(blocks)])
    return base.select("source", "n", F.substring(F.unhex(hexed), 1, size).alias("record"))
