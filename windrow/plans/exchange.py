"""Queries that redistribute rows and show that nothing was lost, added or torn apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.operators import exchange
from windrow.operators.flow import union_all
from windrow.registry import query
from windrow.sources.tables import table

RECEIVERS = 4
_SAME = "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(l_orderkey * 31 + l_linenumber) AS BIGINT) AS weight"


def _same(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_orderkey") * 31 + F.col("l_linenumber")).alias("weight"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")


@query("hash_exchange_invariant", "SELECT l_orderkey % 16 AS class, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_keys, CAST(0 AS BIGINT) AS n_torn FROM lineitem GROUP BY l_orderkey % 16")
def hash_exchange_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = exchange.by_hash(_lines(spark, sf_dir), 7, "l_orderkey").withColumn("p", F.spark_partition_id())
    keys = placed.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), (F.min("p") != F.max("p")).cast("long").alias("torn"))
    return keys.groupBy((F.col("l_orderkey") % 16).alias("class")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_keys"), F.sum("torn").alias("n_torn"))


@query("rebalance_invariant", f"{_SAME} FROM lineitem")
def rebalance_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _same(exchange.rebalance(_lines(spark, sf_dir), 7))


@query("rescale_invariant", f"{_SAME} FROM lineitem")
def rescale_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _same(exchange.rescale(exchange.by_hash(_lines(spark, sf_dir), 12, "l_orderkey"), 5))


@query("forward_union_count", f"{_SAME} FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1) t")
def forward_union_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir)
    return _same(union_all(li, li.filter("l_linenumber = 1")))


@query("route_by_id", f"SELECT CAST(l_orderkey % {RECEIVERS} AS INT) AS sub, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY l_orderkey % {RECEIVERS}")
def route_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = _lines(spark, sf_dir).withColumn("to", (F.col("l_orderkey") % RECEIVERS).cast("int"))
    routed = exchange.route(to, RECEIVERS, "to").withColumn("sub", F.spark_partition_id())
    return routed.groupBy("sub").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("broadcast_replicate", f"SELECT CAST(t AS INT) AS task, CAST(count(*) AS BIGINT) AS n FROM nation, (SELECT unnest(range(0, {RECEIVERS})) AS t) r GROUP BY t")
def broadcast_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.to_all(table(spark, sf_dir, "nation"), RECEIVERS).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@query(
    "bytes_out_vs_produced",
    f"""
    SELECT CAST(sum(octet_length(encode(text)) * CASE WHEN doc_id % 50 = 0 THEN {RECEIVERS} ELSE 1 END) AS BIGINT) AS bytes_out,
      CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes_produced, CAST(count(*) AS BIGINT) AS n_buffers FROM documents
    """,
)
def bytes_out_vs_produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50 == 0).alias("to_all"), F.octet_length("text").alias("bytes"))
    return exchange.sent_and_produced(d, F.col("bytes"), F.col("to_all"), RECEIVERS)


@query("fan_in_counts", "SELECT l_suppkey % 8 AS producer, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_orderkey % 4) AS BIGINT) AS n_subs FROM lineitem GROUP BY l_suppkey % 8")
def fan_in_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("producer"), (F.col("l_orderkey") % 4).cast("int").alias("sub"))
    return exchange.route(li, 4, "sub").groupBy("producer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sub").alias("n_subs"))


@query(
    "compressed_round_trip",
    "SELECT doc_id AS id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS sha, true AS no_larger, length(text) > 200 AS is_compressed FROM documents WHERE length(text) > 200 OR length(text) < 10",
)
def compressed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of some length shrink, those of a few letters are stored as they are; all come back."""
    d = table(spark, sf_dir, "documents").filter("length(text) > 200 or length(text) < 10").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("payload"))
    stored = exchange.compressed(d)
    back = exchange.decompressed(stored).select("id", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha"))
    return back.join(stored.select("id", F.octet_length("stored").alias("n"), "is_compressed"), "id").select("id", "bytes", "sha", (F.col("n") <= F.col("bytes")).alias("no_larger"), "is_compressed")


_CHANNELS = "SELECT l_suppkey AS gate, l_orderkey * 8 + l_linenumber AS turn, CAST(l_quantity AS BIGINT) AS takes FROM lineitem"


@query(
    "open_channels",
    f"""
    WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY turn, takes) AS i FROM ({_CHANNELS}) x),
    o AS (
      SELECT gate, turn, takes, i, [0, 0, takes]::BIGINT[] AS ends, CAST(0 AS BIGINT) AS opens FROM c WHERE i = 1
      UNION ALL SELECT c.gate, c.turn, c.takes, c.i, list_sort(list_append(o.ends[2:], o.ends[1] + c.takes)), o.ends[1] FROM o JOIN c ON c.gate = o.gate AND c.i = o.i + 1)
    SELECT gate, turn, takes, opens, opens + takes AS closes FROM o
    """,
)
def open_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return exchange.opened(li.select(F.col("l_suppkey").alias("gate"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("turn"), F.col("l_quantity").cast("long").alias("takes")), 3)


@query(
    "buffer_grants",
    """
    WITH RECURSIVE q AS (
      SELECT l_suppkey AS pool, l_orderkey * 8 + l_linenumber AS seq, CAST(l_linenumber AS BIGINT) AS least, CAST(l_quantity AS BIGINT) + l_linenumber AS most,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 8 + l_linenumber, CAST(l_quantity AS BIGINT) + l_linenumber) AS i FROM lineitem),
    g AS (
      SELECT pool, seq, least, most, i, CASE WHEN 500 < least THEN -1 ELSE 500 - least(500, most) END AS rest, CASE WHEN 500 >= least THEN least(500, most) END AS granted FROM q WHERE i = 1
      UNION ALL SELECT q.pool, q.seq, q.least, q.most, q.i, CASE WHEN g.rest < q.least THEN -1 ELSE g.rest - least(g.rest, q.most) END, CASE WHEN g.rest >= q.least THEN least(g.rest, q.most) END
      FROM g JOIN q ON q.pool = g.pool AND q.i = g.i + 1)
    SELECT pool, seq, least, most, CAST(granted AS BIGINT) AS granted FROM g
    """,
)
def buffer_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber").cast("long")
    return exchange.granted(li.select(F.col("l_suppkey").alias("pool"), (F.col("l_orderkey") * 8 + n).alias("seq"), n.alias("least"), (F.col("l_quantity").cast("long") + n).alias("most")), 500)
