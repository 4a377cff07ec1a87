"""Chat formatting: cumulative-snapshot collapse, then rendering; DataFrame functions only.

Logs often hold a conversation once after every turn. A running XOR of position-tagged hashes
gives every turn the hash of the prefix that ends there. A conversation whose whole hash is the
proper-prefix hash of another is a snapshot of it and goes by anti-join; of equal conversations
the smallest id stays.

The keys are 128 bits and the turn's number. Prefix keys are made distinct, and whole keys
grouped, before they meet, so a first turn that a third of all conversations share is one row
for each task.

Defined results: turns are ordered by (turn, role, text), nulls first, and repeated turns are
turns; a null role or text differs from an empty one in the hash and renders as empty; markers in a
role or text are rendered with their bars doubled, so that only ``render`` opens and closes turns;
all rows with a null id are one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.sources.tables import table

START, END = "<|im_start|>", "<|im_end|>"


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("i"), F.isnull("role"), F.col("role"), F.isnull("text"), F.col("text"))


def maximal(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``n_turns`` of the conversations that are no copy or prefix of another."""
    t = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = Window.partitionBy("id").orderBy("turn", "role", "text")
    to_here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = (
        t.withColumn("i", F.row_number().over(order))
        .withColumns({"h1": _turn_hash(1), "h2": _turn_hash(2)})
        .select("id", "i", F.bit_xor("h1").over(to_here).alias("h1"), F.bit_xor("h2").over(to_here).alias("h2"), F.lead(F.lit(True)).over(order).isNull().alias("last"))
    )
    whole = keys.filter("last").groupBy("i", "h1", "h2").agg(F.min("id").alias("id"))
    prefixes = keys.filter("not last").select("i", "h1", "h2").distinct()
    return whole.join(prefixes, ["i", "h1", "h2"], "left_anti").select(F.col("id").alias(id_col), F.col("i").cast("long").alias("n_turns"))


def render(turns: DataFrame, keep: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The conversations of ``keep`` as one text each: ``id_col, n_turns, rendered``."""
    t = turns.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("t"))
    k = keep.select(F.col(id_col).alias("kept"), "n_turns")
    lists = t.join(k, t["id"].eqNullSafe(k["kept"]), "left_semi").groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"<\|(im_start|im_end)\|>", "<||$1||>")
    line = lambda x: F.concat(F.lit(START), plain(x["role"]), F.lit("\n"), plain(x["text"]), F.lit(END + "\n"))
    return lists.select(F.col("id").alias(id_col), F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", line), "").alias("rendered"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return render(turns, maximal(turns))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (
  SELECT conv_id, i, n, string_agg(coalesce('r' || role, '') || chr(1) || coalesce('t' || text, ''), chr(2)) OVER (PARTITION BY conv_id ORDER BY i) AS k FROM t),
w AS (SELECT i, k, min(conv_id) AS conv_id FROM p WHERE i = n GROUP BY i, k),
m AS (SELECT conv_id FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i < p.n AND p.i = w.i AND p.k = w.k))
SELECT conv_id, count(*) AS n_turns,
  string_agg('<|im_start|>' || regexp_replace(coalesce(role, ''), '<\|(im_start|im_end)\|>', '<||\1||>', 'g') || chr(10)
    || regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<||\1||>', 'g') || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered
FROM t WHERE conv_id IN (SELECT conv_id FROM m) GROUP BY conv_id
"""
