"""Global row numbers without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quantiles of the keys that are literals of a plan; between two of them ranges are equally wide.
MOST_BOUNDS = 1000


def range_of(x: Column, bounds: list[int], parts: int = 1) -> Column:
    """The place of ``x`` among ascending bounds, by halving, and among ``parts`` equal parts of the
    stretch between two of them; it never falls as ``x`` rises, and is null for null."""
    array = F.array(*map(F.lit, bounds)).cast("array<long>")

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        left = F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(F.get(array, mid) <= x, right).otherwise(left)

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda s: s["lo"])
    if parts == 1:
        return F.when(x.isNotNull(), at.cast("long"))

    def part(k: Column) -> Column:
        lo, hi = F.get(array, k - 1).cast("double"), F.get(array, k).cast("double")
        share = F.floor((x.cast("double") - lo) / (hi - lo) * parts)
        return k * parts + F.coalesce(F.greatest(F.lit(0), F.least(share, F.lit(parts - 1))), F.lit(0))

    return F.when(x.isNotNull(), F.get(F.transform(F.array(at), part), F.lit(0)).cast("long"))


def quantiles(df: DataFrame, key: str, ranges: int) -> tuple[list[int], int]:
    """Ascending bounds between about ``ranges`` ranges of as many rows each, and the parts to cut
    each stretch into where that is more than ``MOST_BOUNDS``."""
    cuts = min(ranges, MOST_BOUNDS)
    found = df.agg(F.percentile_approx(key, [k / cuts for k in range(1, cuts)] or [0.5], 10_000)).first()[0] or [0]
    return sorted(set(found)), -(-ranges // cuts)


def numbered(df: DataFrame, key: str, col: str, *ties: str, rows_per_range: int = 100_000) -> DataFrame:
    """``df`` with ``col``: its place, from 1, in ascending order of the whole-number ``key``.

    Keys are cut into ranges between their quantiles; counts of the ranges (few rows) give where each
    one starts, and a window numbers the rows within a range. ``ties`` order rows with equal keys,
    which are all in one range.
    """
    bounds, parts = quantiles(df, key, max(1, df.count() // rows_per_range))
    dealt = df.withColumn("range_", range_of(F.col(key), bounds, parts))
    counts = dealt.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("range_").alias("r_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    within = Window.partitionBy("range_").orderBy(key, *ties)
    out = dealt.withColumn(col, F.row_number().over(within)).join(starts, F.col("range_").eqNullSafe(F.col("r_")))
    return out.withColumn(col, (F.col(col) + F.col("start_")).cast("long")).drop("range_", "r_", "start_")


def cyclic(position: Column, n: Column) -> Column:
    """The place, from 1, that a position takes in turns over ``n`` places."""
    return ((position - 1) % n + 1).cast("long")
