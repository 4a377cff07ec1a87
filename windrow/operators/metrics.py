"""Statistics of stores and clusters, and queries over metrics in long form."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A group name that stands for every group with it as prefix.
ALL_GROUPS = "exchange"


#: Metrics by group. Fixed values.
CATALOGUE = {
    "cluster": """
        num_shuffle_workers num_jobs_serving total_num_data_partitions resource_request_throughput
        hdd_max_free_bytes ssd_max_free_bytes hdd_max_used_bytes ssd_max_used_bytes""",
    "storage": """
        num_data_partitions num_available_writing_buffers num_available_reading_buffers total_num_executors total_num_writing_buffers
        total_num_reading_buffers time_waiting_reading_buffers time_waiting_writing_buffers hdd_max_free_bytes ssd_max_free_bytes hdd_max_used_bytes
        ssd_max_used_bytes total_partition_file_bytes total_data_file_bytes total_index_file_bytes max_data_file_bytes max_index_file_bytes
        avg_data_file_bytes avg_index_file_bytes max_num_data_regions writing_throughput_bytes reading_throughput_bytes""",
    "network": """
        num_writing_connections num_reading_connections num_writing_flows num_reading_flows writing_throughput_bytes reading_throughput_bytes""",
}


def catalogued(values: DataFrame, group: str) -> DataFrame:
    """``metric, value``: the catalogue's metrics of a group in long form, from one row of columns so named; null where it has none."""
    named = [(n, F.col(n).cast("double") if n in values.columns else F.lit(None).cast("double")) for n in CATALOGUE[group].split()]
    return values.select(F.explode(F.array(*[F.struct(F.lit(f"{ALL_GROUPS}.{group}.{n}").alias("metric"), c.alias("value")) for n, c in named])).alias("m")).select("m.*")


def store_stats(partitions: DataFrame) -> DataFrame:
    """Count, most regions, and total, largest and average bytes of index and data; averages are
    whole numbers, and 0 without partitions."""
    n = F.count(F.lit(1))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = [n.alias("n_partitions"), z(F.max("regions")).alias("max_regions")]
    for c in ("index_bytes", "data_bytes"):
        out += [z(F.sum(c)).alias(f"total_{c}"), z(F.max(c)).alias(f"max_{c}"), z(F.when(n > 0, F.floor(F.sum(c) / n))).alias(f"avg_{c}")]
    return partitions.agg(*out)


def used_by_storage(partitions: DataFrame) -> DataFrame:
    return partitions.groupBy("storage").agg(F.sum(F.col("index_bytes") + F.col("data_bytes")).cast("long").alias("used"))


def gauges(workers: DataFrame) -> DataFrame:
    """The largest free and used space of either medium, and the number of partitions."""
    tops = [F.max(c).alias(f"max_{c}") for c in ("hdd_free", "ssd_free", "hdd_used", "ssd_used")]
    return workers.agg(*tops, F.coalesce(F.sum("n_partitions"), F.lit(0)).cast("long").alias("n_partitions"))


def select_groups(metrics: DataFrame, groups: Iterable[str] | None, prefix: str = ALL_GROUPS) -> DataFrame:
    """Metrics of the named groups. The prefix stands for all groups that begin with it; where
    nothing is left to ask for, everything is returned; unknown names select nothing."""
    names = set(groups or ())
    begins = F.col("grp").startswith(prefix)
    if prefix not in names:
        return metrics.filter(F.col("grp").isin(*names)) if names else metrics
    names.discard(prefix)
    if not names and metrics.filter(begins).isEmpty():
        return metrics
    return metrics.filter(begins | F.col("grp").isin(*names)) if names else metrics.filter(begins)


def summaries(metrics: DataFrame, *shares: float) -> DataFrame:
    """Count, sum and exact percentiles of each metric."""
    ps = [F.percentile("value", F.lit(s)).alias(f"p{round(s * 100)}") for s in shares]
    return metrics.groupBy("grp", "name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), *ps)


def memory_plan(jobs: DataFrame, per_partition: int, per_gate: int, buffer: int) -> DataFrame:
    """Bytes that tasks need for outputs and inputs, and an output's buffers: seven eighths for
    sorting, the rest for transport, both at least one."""
    n = F.floor(F.lit(per_partition) / buffer)
    sort = F.greatest(F.lit(1), F.floor(n * 7 / 8))
    return jobs.select("*", (F.col("outputs") * per_partition + F.col("inputs") * per_gate).cast("long").alias("bytes"), sort.cast("long").alias("sort_buffers"), F.greatest(F.lit(1), n - sort).cast("long").alias("transport_buffers"))


def by_kind(metrics: DataFrame) -> DataFrame:
    """What each kind of metric shows, from ``grp, name, at, value``: a gauge its latest value, a
    counter the sum, a meter events a second from first to last, a timer and a histogram their
    extremes, mean and exact percentiles."""
    seconds = F.unix_micros(F.max("at").cast("timestamp")) - F.unix_micros(F.min("at").cast("timestamp"))
    return metrics.groupBy("grp", "name").agg(
        F.max_by("value", F.struct("at", "value")).alias("gauge"), F.sum("value").alias("counter"), F.count(F.lit(1)).alias("events"),
        F.when(seconds > 0, F.count(F.lit(1)) * 1e6 / seconds).alias("meter"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"),
        F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.99)).alias("p99"),
    )


def occupancy(events: DataFrame) -> DataFrame:
    """``pool, most, last, short``: of the buffers that a pool has given (+) and got back (-) in
    order, how many were out at most and at the end, and how often fewer than none."""
    out = F.sum("buffers").over(Window.partitionBy("pool").orderBy("seq"))
    return events.withColumn("out", out).groupBy("pool").agg(F.max("out").alias("most"), F.max_by("out", "seq").alias("last"), F.sum((F.col("out") < 0).cast("long")).alias("short"))
