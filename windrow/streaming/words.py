"""The word count over a stream of lines; the batch operators do the work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.operators.flow import words


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files that appear in a folder, in a column ``text``."""
    return spark.readStream.text(path).select(F.col("value").alias("text"))


def word_counts(stream: DataFrame) -> DataFrame:
    """Running counts of words, for output mode ``complete`` or ``update``."""
    return words(stream).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
