"""Queries of the control plane: reconciliation, statistics, metrics and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.functions import config, options
from windrow.operators import metrics, reconcile
from windrow.registry import query
from windrow.sources.tables import table

_KNOWN = "SELECT o_custkey % 20 AS worker, o_orderkey AS partition, o_orderkey % 5 = 0 AS releasing FROM orders WHERE o_orderkey % 3 <> 0"
_REPORTS = "SELECT o_custkey % 20 AS worker, o_orderkey AS partition, o_orderkey % 7 = 0 AS releasing FROM orders WHERE o_orderkey % 4 <> 0"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select((F.col("o_custkey") % 20).alias("worker"), F.col("o_orderkey").alias("partition"), (F.col("o_orderkey") % 5 == 0).alias("releasing"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0").select((F.col("o_custkey") % 20).alias("worker"), F.col("o_orderkey").alias("partition"), (F.col("o_orderkey") % 7 == 0).alias("releasing"))


@query(
    "reconcile_actions",
    f"""
    SELECT coalesce(k.worker, r.worker) AS worker, coalesce(k.partition, r.partition) AS partition,
      CASE WHEN k.partition IS NULL THEN CASE WHEN r.releasing THEN 'add_and_drop_meta' ELSE 'add' END
        WHEN k.releasing THEN CASE WHEN r.partition IS NULL THEN 'forget' WHEN r.releasing THEN 'drop_meta' ELSE 'release_data' END
        WHEN r.releasing THEN 'mark_and_drop_meta' ELSE 'none' END AS action
    FROM ({_KNOWN}) k FULL JOIN ({_REPORTS}) r ON k.worker = r.worker AND k.partition = r.partition
    """,
)
def reconcile_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(_known(spark, sf_dir), _reports(spark, sf_dir))


@query(
    "changed_workers",
    f"""
    WITH k AS ({_KNOWN}), c AS (SELECT DISTINCT s_suppkey AS worker FROM supplier WHERE s_suppkey % 4 = 0),
    n AS (SELECT worker, CAST(count(*) AS BIGINT) AS n_partitions FROM k WHERE NOT releasing AND worker % 3 <> 0 GROUP BY worker)
    SELECT worker, 'related' AS change, n_partitions FROM n WHERE worker NOT IN (SELECT worker FROM c)
    UNION ALL SELECT worker, 'unrelated', 0 FROM c WHERE worker NOT IN (SELECT worker FROM n)
    """,
)
def changed_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("worker"))
    return reconcile.changed_workers(_known(spark, sf_dir).filter("worker % 3 <> 0"), cached)


@query("unregister_cascade", f"SELECT worker, CAST(count(*) AS BIGINT) AS n FROM ({_KNOWN}) k WHERE worker % 6 <> 1 GROUP BY worker")
def unregister_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "supplier").filter("s_suppkey % 6 = 1").select(F.col("s_suppkey").alias("worker"))
    gone = gone.unionAll(spark.range(20).filter("id % 6 = 1").select(F.col("id").alias("worker")))
    return reconcile.unregister(_known(spark, sf_dir), gone, "worker").groupBy("worker").agg(F.count(F.lit(1)).alias("n"))


@query("release_by_job", f"SELECT worker, partition, releasing FROM ({_KNOWN}) k WHERE partition % 10 <> 2")
def release_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _known(spark, sf_dir).withColumn("job", F.col("partition") % 10)
    return reconcile.unregister(k, spark.range(2, 3).withColumnRenamed("id", "job"), "job").drop("job")


@query("release_by_partition", f"SELECT worker, partition, releasing FROM ({_KNOWN}) k WHERE partition % 7 <> 3")
def release_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 3").select(F.col("o_orderkey").alias("partition"))
    return reconcile.unregister(_known(spark, sf_dir), gone, "partition").select("worker", "partition", "releasing")


@query("release_by_dataset", f"SELECT worker, partition, releasing FROM ({_KNOWN}) k WHERE partition // 100 NOT IN (1, 4)")
def release_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _known(spark, sf_dir).withColumn("dataset", F.floor(F.col("partition") / 100))
    return reconcile.unregister(k, spark.createDataFrame([(1,), (4,)], "dataset long"), "dataset").select("worker", "partition", "releasing")


@query(
    "readable_partitions",
    "SELECT l_orderkey AS partition, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 9 <> 2 THEN 'readable' ELSE 'not found' END AS state FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1",
)
def readable_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("partition"))
    stored = table(spark, sf_dir, "orders").filter("o_orderkey % 9 <> 2").select(F.col("o_orderkey").alias("partition"), (F.col("o_orderstatus") == "F").alias("finished"))
    return reconcile.readable(wanted, stored)


_OPENED = "SELECT l_partkey AS partition, l_orderkey * 8 + l_linenumber AS writer, epoch_us(l_shipdate) // 1000000 AS begins, epoch_us(l_shipdate) // 1000000 + CAST(l_quantity AS BIGINT) * 2592000 AS ends FROM lineitem"


@query(
    "single_writer",
    f"""
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY begins, writer, ends) AS i FROM ({_OPENED}) x),
    go AS (
      SELECT partition, writer, i, ends AS until, true AS free FROM o WHERE i = 1
      UNION ALL SELECT o.partition, o.writer, o.i, CASE WHEN o.begins >= go.until THEN o.ends ELSE go.until END, o.begins >= go.until FROM go JOIN o ON o.partition = go.partition AND o.i = go.i + 1)
    SELECT partition, writer, CASE WHEN free THEN 'writes' ELSE 'refused' END AS state FROM go
    """,
)
def single_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    begins = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    li = table(spark, sf_dir, "lineitem")
    return reconcile.writers(li.select(F.col("l_partkey").alias("partition"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("writer"), begins.alias("begins"), (begins + F.col("l_quantity").cast("long") * 2_592_000).alias("ends")))


@query(
    "metastore_recovery",
    """
    SELECT o_orderkey AS partition, CASE WHEN o_orderkey % 10 = 0 THEN 'delete_meta' WHEN o_custkey % 3 = 0 AND o_custkey % 4 > 0 THEN 'release_data_and_drop_meta'
      WHEN o_custkey % 3 = 0 OR o_custkey % 4 = 0 THEN 'drop_meta' ELSE 'track' END AS action FROM orders
    """,
)
def metastore_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    return reconcile.recovered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("partition"), (F.col("o_orderkey") % 10 > 0).alias("readable"), (c % 3 == 0).alias("marked"), (c % 4 > 0).alias("has_data")))


_MARKERS = """SELECT l_orderkey AS writer, l_linenumber * 10 + k AS seq,
    CASE k WHEN 0 THEN CASE WHEN l_linenumber % 7 = 5 THEN 'D' ELSE 'S' END WHEN 1 THEN 'D' WHEN 2 THEN 'F' ELSE 'E' END AS marker
  FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last FROM lineitem) l, (SELECT unnest(range(0, 4)) AS k) r WHERE k < 3 OR (l_linenumber = last AND l_orderkey % 5 > 0)"""


@query(
    "marker_streams",
    f"""
    SELECT writer, CAST(count(*) AS BIGINT) AS n, CAST(sum((coalesce(prev, '^') || marker NOT IN ({', '.join(repr(x) for x in reconcile.FOLLOWS)}))::INT) AS BIGINT) AS n_illegal, max_by(marker, seq) = 'E' AS ended
    FROM (SELECT *, lag(marker) OVER (PARTITION BY writer ORDER BY seq) AS prev FROM ({_MARKERS}) m) x GROUP BY writer
    """,
)
def marker_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    last = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last"))
    n = F.col("l_linenumber")
    kinds = F.array(F.when(n % 7 == 5, "D").otherwise("S"), F.lit("D"), F.lit("F"), F.when((n == F.col("last")) & (F.col("l_orderkey") % 5 > 0), "E"))
    m = li.join(last, "l_orderkey").select(F.col("l_orderkey").alias("writer"), n, F.posexplode(kinds).alias("k", "marker")).filter("marker is not null")
    return reconcile.broken_streams(m.select("writer", (F.col("l_linenumber") * 10 + F.col("k")).alias("seq"), "marker"))


@query(
    "end_of_input",
    """
    WITH e AS (SELECT l_suppkey % 40 AS gate, l_partkey % 6 AS channel, l_linenumber AS sub, l_orderkey * 8 + l_linenumber AS seq FROM lineitem WHERE l_linenumber <= 4 AND l_orderkey % 3 > 0),
    s AS (SELECT gate, channel, sub, count(*) AS n, min(seq) AS seq FROM e GROUP BY gate, channel, sub),
    c AS (SELECT gate, channel, count(*) AS subs, sum(n - 1) AS more, max(seq) AS seq FROM s GROUP BY gate, channel)
    SELECT gate, CAST(count(*) AS BIGINT) AS n_channels, CAST(sum((subs = 4)::INT) AS BIGINT) AS n_complete, CAST(sum(more) AS BIGINT) AS n_duplicates, CASE WHEN min((subs = 4)::INT) = 1 THEN max(seq) END AS surfaced FROM c GROUP BY gate
    """,
)
def end_of_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 4 and l_orderkey % 3 > 0")
    return reconcile.ends_of_input(li.select((F.col("l_suppkey") % 40).alias("gate"), (F.col("l_partkey") % 6).alias("channel"), F.col("l_linenumber").alias("sub"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq")), 4)


@query("lost_partitions", "SELECT l_partkey AS partition, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_readers FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 4 > 0) GROUP BY l_partkey")
def lost_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("partition"), F.col("l_suppkey").alias("reader"))
    return reconcile.to_run_again(reads, table(spark, sf_dir, "part").filter("p_size % 4 > 0").select(F.col("p_partkey").alias("partition")))


@query(
    "lost_workers",
    """
    SELECT user_id AS worker, CAST(coalesce(sum((gap > 180)::INT), 0) AS BIGINT) AS n_lost, max(gap) AS longest
    FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000000 AS gap FROM events) g GROUP BY user_id
    """,
)
def lost_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.lost_workers(table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("ts").alias("at")), 180)


@query(
    "channel_order",
    "SELECT l_suppkey AS gate, channel, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5(l_suppkey || '-' || channel), channel) AS turn FROM (SELECT DISTINCT l_suppkey, l_partkey % 16 AS channel FROM lineitem) c",
)
def channel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of a gate in an order drawn by a hash; reruns agree."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("gate"), (F.col("l_partkey") % 16).alias("channel")).distinct()
    drawn = Window.partitionBy("gate").orderBy(F.md5(F.concat_ws("-", F.col("gate").cast("string"), F.col("channel").cast("string"))), "channel")
    return c.withColumn("turn", F.row_number().over(drawn).cast("long"))


_PARTS = "SELECT l_partkey % 5 AS storage, CAST(l_linenumber AS BIGINT) AS regions, CAST(l_linenumber * 20 AS BIGINT) AS index_bytes, CAST(l_quantity * 1000 AS BIGINT) AS data_bytes FROM lineitem"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("long")
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 5).alias("storage"), n.alias("regions"), (n * 20).alias("index_bytes"), (F.col("l_quantity") * 1000).cast("long").alias("data_bytes"))


def _stats_sql(source: str) -> str:
    both = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS total_{c}, coalesce(max({c}), 0) AS max_{c}, CAST(coalesce(sum({c}) // nullif(count(*), 0), 0) AS BIGINT) AS avg_{c}" for c in ("index_bytes", "data_bytes"))
    return f"SELECT CAST(count(*) AS BIGINT) AS n_partitions, coalesce(max(regions), 0) AS max_regions, {both} FROM ({source}) p"


@query("store_stats", _stats_sql(_PARTS))
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.store_stats(_parts(spark, sf_dir))


@query("store_stats_empty", _stats_sql(_PARTS + " WHERE false"))
def store_stats_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.store_stats(_parts(spark, sf_dir).filter(F.lit(False)))


@query("used_bytes_by_storage", f"SELECT storage, CAST(sum(index_bytes + data_bytes) AS BIGINT) AS used FROM ({_PARTS}) p GROUP BY storage")
def used_bytes_by_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.used_by_storage(_parts(spark, sf_dir))


@query(
    "cluster_gauges",
    """
    SELECT max(s_suppkey * 7919 % 2048) AS max_hdd_free, max(s_suppkey * 104729 % 2048) AS max_ssd_free, max(s_suppkey * 1299709 % 2048) AS max_hdd_used,
      max(CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE s_suppkey * 15485863 % 2048 END) AS max_ssd_used, CAST(sum(s_suppkey * 31 % 40) AS BIGINT) AS n_partitions FROM supplier
    """,
)
def cluster_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windrow.plans.placement import workers

    return metrics.gauges(workers(spark, sf_dir))


@query(
    "metric_catalogue",
    """
    SELECT 'exchange.cluster.' || name AS metric, value FROM (
      SELECT unnest(['num_shuffle_workers', 'num_jobs_serving', 'total_num_data_partitions', 'resource_request_throughput', 'hdd_max_free_bytes', 'ssd_max_free_bytes', 'hdd_max_used_bytes', 'ssd_max_used_bytes']) AS name,
        unnest([count(*)::DOUBLE, (SELECT count(DISTINCT o_custkey) FROM orders)::DOUBLE, sum(s_suppkey * 31 % 40)::DOUBLE, NULL, max(s_suppkey * 7919 % 2048)::DOUBLE, max(s_suppkey * 104729 % 2048)::DOUBLE,
          max(s_suppkey * 1299709 % 2048)::DOUBLE, max(CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE s_suppkey * 15485863 % 2048 END)::DOUBLE]) AS value FROM supplier) m
    """,
)
def metric_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of the cluster, as far as the tables tell them."""
    from windrow.plans.placement import workers

    w = workers(spark, sf_dir)
    g = metrics.gauges(w).select("*", *[F.col(f"max_{m}_{k}").alias(f"{m}_max_{k}_bytes") for m in ("hdd", "ssd") for k in ("free", "used")], F.col("n_partitions").alias("total_num_data_partitions"))
    n = w.agg(F.count(F.lit(1)).alias("num_shuffle_workers"))
    jobs = table(spark, sf_dir, "orders").agg(F.countDistinct("o_custkey").alias("num_jobs_serving"))
    one = g.join(F.broadcast(n), F.lit(True)).join(F.broadcast(jobs), F.lit(True))  # a row each
    return metrics.catalogued(one, "cluster")


_METRICS = """SELECT CASE event_type WHEN 'view' THEN 'jvm' WHEN 'click' THEN 'system' WHEN 'error' THEN 'exchange.errors' WHEN 'purchase' THEN 'exchange.store' ELSE 'other' END AS grp,
  'm' || user_id % 3 AS name, value FROM events"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"view": "jvm", "click": "system", "error": "exchange.errors", "purchase": "exchange.store"}
    grp = F.lit("other")
    for k, v in names.items():
        grp = F.when(F.col("event_type") == k, v).otherwise(grp)
    return table(spark, sf_dir, "events").select(grp.alias("grp"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("name"), "value", F.col("ts").alias("at"))


def _by_group(df: DataFrame) -> DataFrame:
    return df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("metric_group_filter", f"SELECT grp, CAST(count(*) AS BIGINT) AS n FROM ({_METRICS}) m WHERE grp LIKE 'exchange%' OR grp = 'jvm' GROUP BY grp")
def metric_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_group(metrics.select_groups(_metrics(spark, sf_dir), ["exchange", "jvm", "no-such"]))


@query("metric_group_unknown", f"SELECT grp, CAST(count(*) AS BIGINT) AS n FROM ({_METRICS}) m WHERE false GROUP BY grp")
def metric_group_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_group(metrics.select_groups(_metrics(spark, sf_dir), ["no-such"]))


@query("metric_group_all", f"SELECT grp, CAST(count(*) AS BIGINT) AS n FROM ({_METRICS}) m WHERE grp IN ('jvm', 'system', 'other') GROUP BY grp")
def metric_group_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = _metrics(spark, sf_dir).filter("grp not like 'exchange%'")
    return _by_group(metrics.select_groups(others, ["exchange"]))


@query("metric_summaries", f"SELECT grp, name, CAST(count(*) AS BIGINT) AS n, min(value) AS low, max(value) AS high, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM ({_METRICS}) m GROUP BY grp, name")
def metric_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summaries(_metrics(spark, sf_dir), 0.5, 0.95)


_EVENTS = _METRICS.replace("value FROM events", "ts, value FROM events")


@query(
    "metric_kinds",
    f"""
    SELECT grp, name, max_by(value, (ts, value)) AS gauge, sum(value) AS counter, CAST(count(*) AS BIGINT) AS events, CASE WHEN max(ts) > min(ts) THEN count(*) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts))) END AS meter,
      min(value) AS low, max(value) AS high, avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM ({_EVENTS}) m GROUP BY grp, name
    """,
)
def metric_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_kind(_metrics(spark, sf_dir))


@query(
    "pool_occupancy",
    """
    SELECT pool, max(held) AS most, max_by(held, seq) AS last, CAST(sum((held < 0)::INT) AS BIGINT) AS short FROM (
      SELECT pool, seq, CAST(sum(buffers) OVER (PARTITION BY pool ORDER BY seq) AS BIGINT) AS held FROM (
        SELECT l_suppkey % 20 AS pool, l_orderkey * 8 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS BIGINT) ELSE -CAST(l_quantity AS BIGINT) END AS buffers FROM lineitem) e) o GROUP BY pool
    """,
)
def pool_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_quantity").cast("long")
    e = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("pool"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_linenumber") % 2 == 1, n).otherwise(-n).alias("buffers"))
    return metrics.occupancy(e)


@query(
    "memory_plan",
    """
    SELECT job, outputs, inputs, CAST(outputs * 67108864 + inputs * 33554432 AS BIGINT) AS bytes, CAST(2048 * 7 // 8 AS BIGINT) AS sort_buffers, CAST(2048 - 2048 * 7 // 8 AS BIGINT) AS transport_buffers
    FROM (SELECT o_custkey % 50 AS job, CAST(count(*) AS BIGINT) AS outputs, CAST(count(DISTINCT o_custkey) AS BIGINT) AS inputs FROM orders GROUP BY 1) t
    """,
)
def memory_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("job")).agg(F.count(F.lit(1)).alias("outputs"), F.countDistinct("o_custkey").alias("inputs"))
    return metrics.memory_plan(jobs, 64 << 20, 32 << 20, 32 << 10)


def _case(units: dict[str, int]) -> str:
    return "CASE u " + " ".join(f"WHEN '{u}' THEN {n}" for u, n in units.items()) + " END"


_TEXTS = "SELECT p_partkey, ' ' || p_size || CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'k' WHEN 2 THEN ' MB' WHEN 3 THEN 'GibiBytes' WHEN 4 THEN ' t ' WHEN 5 THEN 'ms' WHEN 6 THEN ' Min' ELSE ' days' END AS s FROM part"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.element_at(F.array(*map(F.lit, ("", "k", " MB", "GibiBytes", " t ", "ms", " Min", " days"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), F.col("p_size").cast("string"), units).alias("s"))


@query(
    "parse_units",
    f"""
    SELECT p_partkey, CAST(coalesce(n * CASE WHEN u = '' THEN 1 ELSE {_case(config.MEMORY_UNITS)} END, -1) AS BIGINT) AS bytes,
      CAST(coalesce(n * CASE WHEN u = '' THEN 1000000 ELSE {_case(config.TIME_UNITS)} END, -1) AS BIGINT) AS nanos
    FROM (SELECT p_partkey, CAST(regexp_extract(trim(s), '^[0-9]+') AS BIGINT) AS n, lower(trim(regexp_replace(trim(s), '^[0-9]+', ''))) AS u FROM ({_TEXTS}) a) b
    """,
)
def parse_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("p_partkey", F.coalesce(config.memory_bytes(F.col("s")), F.lit(-1)).alias("bytes"), F.coalesce(config.duration_nanos(F.col("s")), F.lit(-1)).alias("nanos"))


@query(
    "split_quoted_list",
    """
    SELECT p_partkey, unnest(['k' || p_size, p_brand || ';' || p_type, p_name || '''s']) AS item, unnest([1, 2, 3]) AS nth FROM part
    """,
)
def split_quoted_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = [F.concat(F.lit("k"), F.col("p_size").cast("string")), F.concat("p_brand", F.lit(";"), "p_type"), F.concat("p_name", F.lit("'s"))]
    line = F.concat_ws(";", *[config.quoted(i) for i in items])
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(config.split_quoted(line)).alias("p", "item")).select("p_partkey", "item", (F.col("p") + 1).alias("nth"))


@query(
    "split_quoted_oddities",
    """
    SELECT p_partkey, CAST(coalesce(len(items), -1) AS INT) AS n, array_to_string(items, '|') AS items FROM (
      SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN ['A', '', 'B'] WHEN 1 THEN ['', 'B'] WHEN 4 THEN ['A', 'B'] WHEN 5 THEN ['it''s;', 'x"y'] WHEN 6 THEN ['', p_brand || ' x'] WHEN 7 THEN [] END AS items FROM part) t
    """,
)
def split_quoted_oddities(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = ["A;;B", "'';B", "'a'x;B", "'open;B", ";A; B ;", "'it''s;' ; \"x\"\"y\"", None, "  "]
    line = F.coalesce(F.element_at(F.array(*map(F.lit, odd)), (F.col("p_partkey") % 8 + 1).cast("int")), F.concat(F.lit(" ; ;"), "p_brand", F.lit(" x ")))
    d = table(spark, sf_dir, "part").select("p_partkey", config.split_quoted(line).alias("items"))
    return d.select("p_partkey", F.coalesce(F.size("items"), F.lit(-1)).alias("n"), F.array_join("items", "|").alias("items"))


@query(
    "typed_options",
    """
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 7 WHEN p_size % 3 = 1 THEN p_size ELSE NULL END AS retries, CASE WHEN p_size % 2 = 0 THEN p_size % 4 = 0 ELSE true END AS compress,
      CAST(CASE WHEN p_size % 5 = 0 THEN 32768 ELSE p_size * 1024 END AS BIGINT) AS buffer, CAST(p_size AS BIGINT) * 1000000000 AS timeout, CAST(0.75 AS DOUBLE) AS share FROM part
    """,
)
def typed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    o = F.map_filter(F.create_map(
        F.lit("retries"), F.when(F.col("p_size") % 3 == 1, F.concat(F.lit(" "), size)).when(F.col("p_size") % 3 == 2, F.lit("many")),
        F.lit("compress"), F.when(F.col("p_size") % 4 == 0, F.lit("TRUE")).when(F.col("p_size") % 2 == 0, F.lit("false")),
        F.lit("buffer"), F.when(F.col("p_size") % 5 != 0, F.concat(size, F.lit("k"))),
        F.lit("timeout"), F.concat(size, F.lit(" s")),
    ), lambda k, v: v.isNotNull())
    return table(spark, sf_dir, "part").select(
        "p_partkey", options.option(o, "retries", "int", 7).alias("retries"), options.option(o, "compress", "boolean", True).alias("compress"),
        options.option(o, "buffer", "memory", 32_768).alias("buffer"), options.option(o, "timeout", "duration", 0).alias("timeout"), options.option(o, "share", "double", 0.75).alias("share"),
    )


@query("unframed_bytes", "SELECT n_nationkey, n_name AS first, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'x' || n_regionkey END AS second, CAST(CASE WHEN n_nationkey % 5 = 0 THEN -1 ELSE 2 END AS INT) AS pieces FROM nation WHERE n_nationkey % 5 > 0 UNION ALL SELECT n_nationkey, NULL, NULL, -1 FROM nation WHERE n_nationkey % 5 = 0")
def unframed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two framed pieces in a row are told apart; bytes that don't come out even are no frames."""
    k = F.col("n_nationkey")
    second = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("x"), F.col("n_regionkey").cast("string")))
    both = F.concat(config.with_length(F.col("n_name").cast("binary")), config.with_length(second.cast("binary")), F.when(k % 5 == 0, F.lit(b"\x00")).otherwise(F.lit(b"")))
    got = config.split_framed(both)
    d = table(spark, sf_dir, "nation").select("n_nationkey", got.alias("p"))
    return d.select("n_nationkey", F.get("p", F.lit(0)).cast("string").alias("first"), F.get("p", F.lit(1)).cast("string").alias("second"), F.coalesce(F.size("p"), F.lit(-1)).alias("pieces"))


@query(
    "data_dirs",
    """
    SELECT s_suppkey, unnest(['SSD', 'HDD', 'HDD']) AS medium, unnest(['/a' || s_suppkey || '/', '/b/', '/c' || s_nationkey || '/']) AS path FROM supplier
    """,
)
def data_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("[SSD]/a"), F.col("s_suppkey").cast("string"), F.lit(", [HDD]/b/ ,, /c"), F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(config.data_dirs(line)).alias("d")).select("s_suppkey", "d.*")


@query("framed_bytes", "SELECT n_nationkey, printf('%08x', octet_length(encode(n_name))) || lower(hex(encode(n_name))) AS framed FROM nation")
def framed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.lower(F.hex(config.with_length(F.col("n_name").cast("binary")))).alias("framed"))
