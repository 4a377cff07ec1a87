"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within each source the keys are dealt into ranges, the
ranges' token counts are summed, and the prefix sums over ranges (few rows) and within a range
(a window over about ``rows_per_range`` rows) give each document its place in the source's
order. The budget cuts that order at an exact token; whole epochs come first.

A hot source is no hot task: keys are uniform, so its ranges are as small as any other's.

Defined results: null text has size 0; a null source is a source of its own, last in order; a
row with a null id is keyed by a hash of all its columns, and rows that share an id are ordered by
their sizes and such a hash; repeated rows count one by one; an empty table gives no rows;
other columns are carried along untouched, whatever their names, in the struct ``doc``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.llm.common import n_words, saved
from windrow.sources.scratch import tidied
from windrow.sources.tables import table

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MAX_EPOCHS = 3
ROWS_PER_RANGE = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``src, source_size`` -> also ``target``: shares of the total by weight, where no target
    exceeds ``max_epochs`` times its source and the excess goes to the others by weight.

    Sources fill up in the order of cap / weight, so the filled ones are a prefix of that order
    and one running sum finds where it ends. The windows run over one row for each source.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    before = Window.orderBy("level", "nth").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    out = (
        sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())))
        .withColumn("weight", w.cast("double"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), none))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("cap") <= F.col("weight") * (F.col("total") - F.col("caps_before")) / (F.col("weights") - F.col("weights_before")))
        .withColumn("caps_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(none)).over(everything))
        .withColumn("weights_full", F.sum(F.when(F.col("full"), F.col("weight")).otherwise(F.lit(0.0))).over(everything))
    )
    rest = F.col("weight") * (F.col("total") - F.col("caps_full")) / F.nullif(F.col("weights") - F.col("weights_full"), F.lit(0.0))
    return out.select("src", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(rest).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | str = "size",
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``doc, size, source_size, target, taken, epochs``: ``taken`` tokens of each document, of
    which ``epochs`` whole passes; the rest is a prefix of it."""
    rows = docs.count()
    digits = max(0, math.ceil(math.log(max(1.0, rows / rows_per_range), 16)))
    keyed = (
        docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("src"), (F.col(size) if isinstance(size, str) else size).alias("size"))
        .withColumn("tie", F.xxhash64("doc"))
        .withColumn("key", F.md5(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null "), F.col("tie").cast("string")))))
        .withColumn("range", F.substring("key", 1, digits) if digits else F.lit(""))
    )
    ranges = keyed.groupBy(F.col("src").alias("s"), F.col("range").alias("r")).agg(F.sum("size").alias("range_size"))
    sizes = ranges.groupBy(F.col("s").alias("src")).agg(F.sum("range_size").alias("source_size"))
    before = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("s", "r", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("start"))
    goal = F.floor(F.col("target") + 0.5)
    plan = (
        starts.join(targets(sizes, weights, max_epochs), F.col("s").eqNullSafe(F.col("src"))).drop("src")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", (goal - F.col("epochs") * F.col("source_size")).cast("long"))
    )
    within = Window.partitionBy("src", "range").orderBy("key", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(plan, placed["src"].eqNullSafe(plan["s"]) & (placed["range"] == plan["r"]))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("within")))
    return joined.select("doc", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "epochs")


@tidied
def mixed_texts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` as the mix has them: a row for each pass over a document, the last one cut after
    the words that are still wanted; documents of which nothing is taken are left out."""
    m = mix(docs, id_col, source_col, n_words(F.col(text_col)), **options)
    text, left = F.col("doc")[text_col], F.col("taken") - F.col("epochs") * F.col("size")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(pieces, 1, F.greatest(left, F.lit(1)).cast("int")), "")
    last = F.when(left >= F.col("size"), F.array(text)).when(left > 0, F.array(head)).otherwise(F.array().cast("array<string>"))
    copies = F.concat(F.array_repeat(text, F.col("epochs").cast("int")), last)
    m = m.filter(F.col("taken") > 0).select("doc", F.explode(copies).alias("text"))
    return m.select(*[F.col("text").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])


@tidied
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = saved(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return mix(sized).select("doc.doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS nth,
    CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
    source_size * 3 AS cap FROM s),
r AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, sum(weight) OVER () AS weights,
    CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS caps_before,
    coalesce(sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights_before FROM w),
f AS (SELECT *, cap <= weight * (total - caps_before) / (weights - weights_before) AS is_full FROM r),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE)
    ELSE weight * (total - CAST(sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS BIGINT)) / nullif(weights - sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER (), 0) END AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY coalesce(md5(CAST(d.doc_id AS VARCHAR)), ''), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, goal - epochs * source_size - before)) AS BIGINT) AS taken FROM e
"""
