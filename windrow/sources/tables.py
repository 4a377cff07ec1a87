"""Parquet tables by name under a directory that Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; no listing or opening outside Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
