"""Queries that place partitions on workers (suppliers) for requests (orders), and on disks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.operators import placement
from windrow.registry import query
from windrow.sources.tables import table

RESERVE, LIMIT = 500, 1800

_WORKERS = """
w AS (
  SELECT s_suppkey AS worker, CAST(s_nationkey AS BIGINT) AS host, s_suppkey * 7919 % 2048 AS hdd_free, s_suppkey * 104729 % 2048 AS ssd_free,
    s_suppkey * 1299709 % 2048 AS hdd_used, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE s_suppkey * 15485863 % 2048 END AS ssd_used, s_suppkey * 31 % 40 AS n_partitions
  FROM supplier),
v AS (
  SELECT * FROM w WHERE (coalesce(hdd_free, 0) > {r} AND coalesce(hdd_used, 0) < {l}) OR (coalesce(ssd_free, 0) > {r} AND coalesce(ssd_used, 0) < {l})),
t AS (SELECT *, row_number() OVER (ORDER BY worker) AS turn, count(*) OVER () AS n FROM v)
""".format(r=RESERVE, l=LIMIT)


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("worker"), F.col("s_nationkey").cast("long").alias("host"), (k * 7919 % 2048).alias("hdd_free"), (k * 104729 % 2048).alias("ssd_free"),
        (k * 1299709 % 2048).alias("hdd_used"), F.when(k % 13 != 0, k * 15485863 % 2048).alias("ssd_used"), (k * 31 % 40).alias("n_partitions"),
    )


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.valid(workers(spark, sf_dir), RESERVE, LIMIT)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 50).alias("job"), (F.col("o_custkey") % 40).alias("host"), F.floor(F.col("o_orderkey") / 3).alias("map_partition"))


@query("valid_workers", f"WITH {_WORKERS} SELECT worker, host FROM v")
def valid_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid(spark, sf_dir).select("worker", "host")


_ROUND = f"WITH {_WORKERS}, q AS (SELECT o_orderkey AS request, row_number() OVER (ORDER BY o_orderkey) AS nth FROM orders)"


@query("place_round_robin", f"{_ROUND} SELECT request, worker FROM q JOIN t ON turn = (nth - 1) % n + 1")
def place_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.strategy("Round-Robin")(requests(spark, sf_dir), valid(spark, sf_dir))


@query(
    "place_min_num",
    f"""
    {_ROUND}, places AS (SELECT worker, row_number() OVER (ORDER BY level, worker) AS nth FROM (SELECT worker, unnest(range(n_partitions, (SELECT count(*) FROM orders) // (SELECT count(*) FROM v) + (SELECT max(n_partitions) FROM v) + 2)) AS level FROM v) p)
    SELECT request, worker FROM q JOIN places USING (nth)
    """,
)
def place_min_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.strategy("min-num")(requests(spark, sf_dir), valid(spark, sf_dir))


@query(
    "place_locality",
    f"""
    WITH {_WORKERS}, near AS (SELECT host, max(worker) AS near FROM v GROUP BY host),
    q AS (SELECT o_orderkey AS request, near FROM orders LEFT JOIN near ON host = o_custkey % 40),
    miss AS (SELECT request, row_number() OVER (ORDER BY request) AS nth FROM q WHERE near IS NULL)
    SELECT request, near AS worker FROM q WHERE near IS NOT NULL
    UNION ALL SELECT request, worker FROM miss JOIN t ON turn = (nth - 1) % n + 1
    """,
)
def place_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.strategy("locality")(requests(spark, sf_dir), valid(spark, sf_dir))


@query(
    "place_random",
    f"WITH {_WORKERS} SELECT o_orderkey AS request, worker FROM orders JOIN t ON turn = CAST('0x' || left(md5(CAST(o_orderkey AS VARCHAR)), 8) AS BIGINT) % n + 1",
)
def place_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.strategy("random")(requests(spark, sf_dir), valid(spark, sf_dir))


@query(
    "place_once",
    f"""
    WITH {_WORKERS}, k AS (SELECT o_orderkey // 3 AS mp, min(o_orderkey) AS first FROM orders GROUP BY 1),
    q AS (SELECT mp, row_number() OVER (ORDER BY first) AS nth FROM k)
    SELECT o_orderkey AS request, worker FROM orders JOIN q ON mp = o_orderkey // 3 JOIN t ON turn = (nth - 1) % n + 1
    """,
)
def place_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.once_for_each_key(requests(spark, sf_dir), ["map_partition"], valid(spark, sf_dir))


@query("placement_distribution", f"{_ROUND} SELECT worker, CAST(count(*) AS BIGINT) AS n FROM q JOIN t ON turn = (nth - 1) % n + 1 GROUP BY worker")
def placement_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.round_robin(requests(spark, sf_dir), valid(spark, sf_dir)).groupBy("worker").agg(F.count(F.lit(1)).alias("n"))


_DISKS = """
d AS (
  SELECT p_partkey % 50 AS worker, p_partkey AS disk, CASE WHEN p_partkey % 3 = 0 THEN 'SSD' ELSE 'HDD' END AS medium, p_partkey * 7919 % 2048 AS free, p_partkey * 104729 % 2048 AS used, p_size % 5 > 0 AS healthy FROM part),
s AS (
  SELECT *, CASE WHEN free > 1500 AND used < 1000 AND medium = 'SSD' THEN 0 WHEN free > 1500 AND used < 1000 THEN 1 WHEN medium = 'SSD' THEN 2 ELSE 3 END AS score,
    CASE WHEN free > 1500 AND used < 1000 THEN 0 ELSE -free END AS rest FROM d WHERE healthy {only}),
f AS (SELECT *, dense_rank() OVER (PARTITION BY worker ORDER BY score, rest) AS r FROM s),
p AS (SELECT worker, disk, medium, row_number() OVER (PARTITION BY worker ORDER BY disk) AS turn, count(*) OVER (PARTITION BY worker) AS n FROM f WHERE r = 1)
"""
_ASKED = "q AS (SELECT o_orderkey AS request, o_custkey % 50 AS worker, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS nth FROM orders)"
_SPREAD = f"{_ASKED} SELECT request, q.worker, disk, medium FROM q JOIN p ON p.worker = q.worker AND turn = (nth - 1) % n + 1"


def disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((k % 50).alias("worker"), k.alias("disk"), F.when(k % 3 == 0, "SSD").otherwise("HDD").alias("medium"), (k * 7919 % 2048).alias("free"), (k * 104729 % 2048).alias("used"), (F.col("p_size") % 5 > 0).alias("healthy"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 50).alias("worker"))


@query("disk_choice", f"WITH {_DISKS.format(only='')} SELECT worker, disk, medium FROM p WHERE turn = 1")
def disk_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.choose_disk(disks(spark, sf_dir), "SSD", 1500, 1000).select("worker", "disk", "medium")


@query("disk_round_robin", f"WITH {_DISKS.format(only='')}, {_SPREAD}")
def disk_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.spread_over_disks(_asked(spark, sf_dir), disks(spark, sf_dir), "SSD", 1500, 1000)


@query("disk_round_robin_hdd_only", f"WITH {_DISKS.format(only="AND medium = 'HDD'")}, {_SPREAD}")
def disk_round_robin_hdd_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.spread_over_disks(_asked(spark, sf_dir), disks(spark, sf_dir), "HDD", 1500, 1000, only="HDD")


@query("disk_round_robin_ssd_only", f"WITH {_DISKS.format(only="AND medium = 'SSD'")}, {_SPREAD}")
def disk_round_robin_ssd_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.spread_over_disks(_asked(spark, sf_dir), disks(spark, sf_dir), "SSD", 1500, 1000, only="SSD")


@query(
    "disks_by_medium",
    "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'SSD' ELSE 'HDD' END AS medium, CAST(count(*) AS BIGINT) AS n, max(p_partkey * 7919 % 2048) AS most_free FROM part WHERE p_size % 5 > 0 GROUP BY 1",
)
def disks_by_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").filter(F.col("p_size") % 5 > 0)
    return d.groupBy(F.when(F.col("p_partkey") % 3 == 0, "SSD").otherwise("HDD").alias("medium")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("p_partkey") * 7919 % 2048).alias("most_free"))
