"""Dataflow operators as DataFrame expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(df: DataFrame, col: str = "text") -> DataFrame:
    """One row ``word`` for each maximal run of word characters, in lower case."""
    return df.select(F.explode(F.split(F.lower(col), r"\W+")).alias("word")).filter(F.col("word") != "")


def keyed_sum(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias(name))


def count_all(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, dfs)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return union_all(*dfs).distinct()


def replicate(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times."""
    once = F.explode(F.array_repeat(F.lit(1), times)).alias("copy_")
    return df.select("*", once).drop("copy_")


def multiplicity(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def star(fact: DataFrame, *dims: tuple[DataFrame, str, str]) -> DataFrame:
    """Inner equi-joins of a fact table with dimensions: (table, fact column, dimension column)."""
    for dim, left, right in dims:
        fact = fact.join(dim, fact[left] == dim[right])
    return fact


def mod_step(df: DataFrame, factors: tuple[int, int] = (2, 3), modulus: int = 99_999) -> DataFrame:
    """Both columns of a pair times a factor, modulo ``modulus``."""
    return df.select((F.col("f0") * factors[0] % modulus).alias("f0"), (F.col("f1") * factors[1] % modulus).alias("f1"))


def mod_chain(df: DataFrame, partitions: int, stages: int = 3) -> DataFrame:
    """``mod_step`` in ``stages`` stages with a keyed exchange between each and the next."""
    out = mod_step(df)
    for k in range(1, stages):
        out = mod_step(out.repartition(partitions, "f0" if k % 2 else "f1"))
    return out


def checksum(df: DataFrame, modulus: int = 77_777) -> DataFrame:
    """A sum of both columns that does not depend on the order, and the number of rows."""
    return df.agg(F.coalesce(F.sum((F.col("f0") + F.col("f1")) % modulus) % modulus, F.lit(0)).cast("long").alias("checksum"), F.count(F.lit(1)).alias("n_rows"))


def observed_count(df: DataFrame, name: str = "seen") -> tuple[DataFrame, object]:
    """``df`` and an observation of its row count, filled when the plan runs."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen
