"""Choosing a worker or a disk for each partition. Space is looked at once, when placing begins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.operators.ranking import cyclic, numbered


def has_space(reserve: int, limit: int) -> Column:
    """Room on either medium; what was never reported counts as 0, which is no room."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return ((z("hdd_free") > reserve) & (z("hdd_used") < limit)) | ((z("ssd_free") > reserve) & (z("ssd_used") < limit))


def valid(workers: DataFrame, reserve: int, limit: int) -> DataFrame:
    return workers.filter(has_space(reserve, limit))


def _turns(workers: DataFrame) -> DataFrame:
    """Workers with their turn, from 1, in order of registration, and how many there are."""
    return workers.select("worker", F.row_number().over(Window.orderBy("worker")).cast("long").alias("turn"), F.count(F.lit(1)).over(Window.partitionBy()).alias("workers"))


def round_robin(requests: DataFrame, workers: DataFrame) -> DataFrame:
    """``request, worker``: valid workers in turns, in the order of requests."""
    t = _turns(workers)
    n = F.broadcast(t.select("workers").limit(1))  # one row
    placed = numbered(requests.select("request"), "request", "nth").join(n, F.lit(True)).withColumn("turn", cyclic(F.col("nth"), F.col("workers")))
    return placed.drop("workers").join(t, "turn").select("request", "worker")


def min_num(requests: DataFrame, workers: DataFrame) -> DataFrame:
    """``request, worker``: each to the worker with the fewest partitions, the first of equals.

    Partitions fill the workers like water: the places are (level, worker) in that order, and the
    n-th request takes the n-th place. As many places are made as there are requests, and one more
    for each worker at most.
    """
    n = requests.count()
    w = workers.select("worker", F.coalesce("n_partitions", F.lit(0)).alias("have"))
    rising = Window.orderBy("have").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = w.groupBy("have").agg(F.count(F.lit(1)).alias("k"), F.max("worker").alias("top"))  # one row for each number that workers have
    levels = levels.select("have", F.sum("k").over(rising).alias("workers"), F.sum(F.col("k") * F.col("have")).over(rising).alias("held"), F.max("top").over(Window.partitionBy()).alias("top"))
    # The highest that all requests still fill up to; from there they rise evenly.
    last = levels.filter(F.col("workers") * F.col("have") - F.col("held") <= n).orderBy(F.desc("have")).first()
    if not n or not last:
        return requests.select("request").limit(0).withColumn("worker", F.lit(None).cast("long"))
    level = (n + last["held"]) // last["workers"]  # places below it are all taken, and some at it
    places = w.filter(F.col("have") <= level).select("worker", F.explode(F.sequence(F.col("have"), F.lit(level))).alias("level"))
    places = places.withColumn("place", F.col("level") * (last["top"] + 1) + F.col("worker"))
    p = numbered(places, "place", "nth").select("worker", "nth").filter(F.col("nth") <= n)
    return numbered(requests.select("request"), "request", "nth").join(p, "nth").select("request", "worker")


def hashed(requests: DataFrame, workers: DataFrame, seed: str = "") -> DataFrame:
    """``request, worker``: a worker drawn by a hash of the request; reruns agree."""
    t = _turns(workers)
    n = F.broadcast(t.select("workers").limit(1))  # one row
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("request").cast("string"))), 1, 8), 16, 10).cast("long")
    return requests.select("request").join(n, F.lit(True)).withColumn("turn", draw % F.col("workers") + 1).drop("workers").join(t, "turn").select("request", "worker")


def locality(requests: DataFrame, workers: DataFrame) -> DataFrame:
    """``request, worker``: the worker of the request's host (the last registered one), or else
    the next in turn."""
    near = workers.groupBy("host").agg(F.max("worker").alias("near"))
    tried = requests.join(near, "host", "left")
    misses = round_robin(tried.filter("near is null"), workers)
    return tried.filter("near is not null").select("request", F.col("near").alias("worker")).unionAll(misses)


#: Strategies by name, in lower case.
STRATEGIES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"round-robin": round_robin, "min-num": min_num, "random": hashed, "locality": locality}


def strategy(name: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    try:
        return STRATEGIES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown placement strategy {name!r}; known: {', '.join(STRATEGIES)}") from None


def once_for_each_key(requests: DataFrame, keys: list[str], workers: DataFrame, place: Callable[[DataFrame, DataFrame], DataFrame] = round_robin) -> DataFrame:
    """Requests with the worker that the first request with the same keys got."""
    first = requests.groupBy(*keys).agg(F.min("request").alias("first"))
    got = place(first.select(F.col("first").alias("request")), workers).withColumnRenamed("request", "first")
    return requests.join(first, keys).join(got, "first").select("request", "worker")


def _ranked(disks: DataFrame, preferred: str, reserve: int, limit: int) -> DataFrame:
    """Healthy disks with ``first``: whether they are the ones to use on their worker. These are, in
    this order: the preferred ones with room, the others with room, the preferred ones with the most
    free space, the others with the most."""
    room = (F.col("free") > reserve) & (F.col("used") < limit)
    mine = F.col("medium") == preferred
    order = Window.partitionBy("worker").orderBy(F.when(room & mine, 0).when(room, 1).when(mine, 2).otherwise(3), F.when(~room, -F.col("free")))
    return disks.filter("healthy").withColumn("first", F.dense_rank().over(order) == 1)


def spread_over_disks(requests: DataFrame, disks: DataFrame, preferred: str, reserve: int, limit: int, only: str | None = None) -> DataFrame:
    """``request, worker, disk, medium``: the disks of a request's worker in turns, in the order of
    requests; with ``only``, no disks of another medium. Requests for which there is none are left out."""
    pool = _ranked(disks.filter(F.col("medium") == only) if only else disks, preferred, reserve, limit).filter("first")
    pool = pool.select("worker", "disk", "medium", F.row_number().over(Window.partitionBy("worker").orderBy("disk")).cast("long").alias("turn"), F.count(F.lit(1)).over(Window.partitionBy("worker")).alias("disks"))
    nth = F.row_number().over(Window.partitionBy("worker").orderBy("request"))
    sizes = pool.filter("turn = 1").select("worker", "disks")
    asked = requests.select("request", "worker", nth.alias("nth")).join(sizes, "worker").withColumn("turn", cyclic(F.col("nth"), F.col("disks")))
    return asked.select("request", "worker", "turn").join(pool, ["worker", "turn"]).select("request", "worker", "disk", "medium")


def choose_disk(disks: DataFrame, preferred: str, reserve: int, limit: int) -> DataFrame:
    """The disk of each worker that is next: of the preferred medium with room, else of the other
    with room, else the one with the most free space, preferred medium first. Unhealthy ones never."""
    order = Window.partitionBy("worker").orderBy("disk")
    return _ranked(disks, preferred, reserve, limit).filter("first").withColumn("r_", F.row_number().over(order)).filter("r_ = 1").drop("r_", "first")
