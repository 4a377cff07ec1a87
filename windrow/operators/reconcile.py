"""What a manager and its workers must tell each other about partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def action() -> Column:
    """From ``known, reported`` and the releasing flags of both sides."""
    known, reported, mine, theirs = (F.coalesce(F.col(c), F.lit(False)) for c in ("known", "reported", "mgr_releasing", "wrk_releasing"))
    return (
        F.when(~known & reported & theirs, "add_and_drop_meta")
        .when(~known & reported, "add")
        .when(known & mine & ~reported, "forget")
        .when(known & mine & theirs, "drop_meta")
        .when(known & mine, "release_data")
        .when(known & reported & theirs, "mark_and_drop_meta")
        .otherwise("none")
    )


def reconcile(known: DataFrame, reports: DataFrame) -> DataFrame:
    """``worker, partition, action`` for what the manager knows and the workers report."""
    k = known.select("worker", "partition", F.lit(True).alias("known"), F.col("releasing").alias("mgr_releasing"))
    r = reports.select("worker", "partition", F.lit(True).alias("reported"), F.col("releasing").alias("wrk_releasing"))
    return k.join(r, ["worker", "partition"], "full").select("worker", "partition", action().alias("action"))


def changed_workers(current: DataFrame, cached: DataFrame) -> DataFrame:
    """``worker, change, n_partitions``: workers that a job newly uses, and cached ones that it no
    longer does. Partitions that are being released do not count."""
    now = current.filter(~F.col("releasing")).groupBy("worker").agg(F.count(F.lit(1)).alias("n_partitions"))
    new = now.join(cached.select("worker").distinct(), "worker", "left_anti").select("worker", F.lit("related").alias("change"), "n_partitions")
    gone = cached.select("worker").distinct().join(now, "worker", "left_anti").select("worker", F.lit("unrelated").alias("change"), F.lit(0).cast("long").alias("n_partitions"))
    return new.unionAll(gone)


def unregister(partitions: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The partitions that stay when workers or jobs go."""
    return partitions.join(gone.select(key).distinct(), key, "left_anti")


def readable(wanted: DataFrame, partitions: DataFrame) -> DataFrame:
    """``partition, state`` of wanted partitions: only finished ones can be read, others are not found."""
    found = partitions.select("partition", "finished").groupBy("partition").agg(F.max("finished").alias("finished"))
    return wanted.join(found, "partition", "left").select("partition", F.when(F.col("finished"), "readable").otherwise("not found").alias("state"))


def writers(opened: DataFrame) -> DataFrame:
    """``partition, writer, state`` of those that open a partition to write from ``begins`` to ``ends``:
    a second one is refused while the first that was let in is at it.

    Whether one is let in hangs on who was before it, so a partition's writers are gone through in
    order: sorted within partitions and streamed, in constant memory.
    """

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, until = None, 0
        for b in batches:
            out = []
            for p, begins, ends in zip(b["partition"].tolist(), b["begins"].tolist(), b["ends"].tolist(), strict=True):
                if p != now:
                    now, until = p, begins
                free = begins >= until
                until = ends if free else until
                out.append("writes" if free else "refused")
            yield b[["partition", "writer"]].assign(state=out)

    o = opened.select("partition", "writer", "begins", "ends").repartition("partition").sortWithinPartitions("partition", "begins", "writer", "ends")
    return o.mapInPandas(go, "partition long, writer long, state string")


def recovered(metas: DataFrame) -> DataFrame:
    """``partition, action`` for stored descriptions at a restart: unreadable ones are deleted, marked
    ones are released in full, those without data are forgotten, the others are tracked again."""
    action = F.when(~F.col("readable"), "delete_meta").when(F.col("marked") & F.col("has_data"), "release_data_and_drop_meta").when(F.col("marked") | ~F.col("has_data"), "drop_meta").otherwise("track")
    return metas.select("partition", action.alias("action"))


#: What may follow what in a writer's stream: S starts a region, D is data, F finishes a region, E the
#: input. Fixed values.
FOLLOWS = ("^S", "SD", "SF", "DD", "DF", "FS", "FE", "^E")


def broken_streams(markers: DataFrame) -> DataFrame:
    """``writer, n, n_illegal, ended``: markers that can't stand where they do, and whether the input was finished."""
    w = Window.partitionBy("writer").orderBy("seq")
    pair = F.concat(F.coalesce(F.lag("marker").over(w), F.lit("^")), F.col("marker"))
    d = markers.withColumns({"bad": ~pair.isin(*FOLLOWS), "at": F.struct("seq", "marker")})
    return d.groupBy("writer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("n_illegal"), (F.max("at")["marker"] == "E").alias("ended"))


def ends_of_input(events: DataFrame, subs: int) -> DataFrame:
    """``gate, n_channels, n_complete, n_duplicates, surfaced``: end events ``gate, channel, sub, seq`` that
    came in. A channel is complete with one from each of its ``subs``; more than one from the same is an
    error; only the last that completes the last channel is passed on."""
    each = events.groupBy("gate", "channel", "sub").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    channels = each.groupBy("gate", "channel").agg(F.count(F.lit(1)).alias("subs"), F.sum(F.col("n") - 1).alias("more"), F.max("seq").alias("seq"))
    whole = F.min(F.col("subs") == subs)
    return channels.groupBy("gate").agg(F.count(F.lit(1)).alias("n_channels"), F.sum((F.col("subs") == subs).cast("long")).alias("n_complete"), F.sum("more").alias("n_duplicates"), F.when(whole, F.max("seq")).alias("surfaced"))


def to_run_again(reads: DataFrame, available: DataFrame) -> DataFrame:
    """``partition, n_readers``: producers of partitions that readers ask for and no worker has."""
    return reads.join(available.select("partition").distinct(), "partition", "left_anti").groupBy("partition").agg(F.countDistinct("reader").alias("n_readers"))


def lost_workers(beats: DataFrame, seconds: int) -> DataFrame:
    """``worker, n_lost, longest``: how often a worker was silent for more than ``seconds`` before it came back."""
    w = Window.partitionBy("worker").orderBy("at")
    gap = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(w).cast("timestamp"))) / 1_000_000
    return beats.select("worker", gap.alias("gap")).groupBy("worker").agg(F.sum(F.coalesce((F.col("gap") > seconds).cast("long"), F.lit(0))).alias("n_lost"), F.max("gap").alias("longest"))
