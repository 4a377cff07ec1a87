"""How partitioned data is laid out: regions, index, buffers, checksums."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of bookkeeping for each record in a sort buffer.
ENTRY_BYTES = 16
#: Marks an entry of an index and a header of a buffer.
MAGIC = 0x57494E44


def greedy_groups(df: DataFrame, keys: list[str], order: list[str], size: str, capacity: int, mode: str | None = None, entry: int = 0, col: str = "grp") -> DataFrame:
    """Number the groups that records fill in order, from 0 for each key.

    A record opens a group if the one before has no room for it, or is of another ``mode``. One
    that is larger than a whole group has a group to itself. The cut depends on all records
    before, so rows of a key are gone through in order: sorted within partitions and streamed, a
    key of any length in constant memory.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, group, used, kind = None, 0, 0, None
        for b in batches:
            out = []
            modes = b[mode].tolist() if mode else [None] * len(b)
            for key, n, m in zip(zip(*(b[k].tolist() for k in keys), strict=True), b[size].tolist(), modes, strict=True):
                if key != now:
                    now, group, used = key, 0, 0
                need = n + entry
                if used and (m != kind or used + need > capacity):
                    group, used = group + 1, 0
                used, kind = used + need, m
                out.append(group)
            yield b.assign(**{col: out})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(number, f"{fields}, {col} long")


def region_index(regions: DataFrame, subs: int) -> DataFrame:
    """``producer, region, sub, offset, bytes``: where the bytes of each region and subpartition
    are in the producer's file. A region for all is stored once and every entry points to it."""
    size = regions.groupBy("producer", "region").agg(F.first("is_broadcast").alias("is_broadcast"), *[F.sum(F.when(F.col("sub") == s, F.col("bytes")).otherwise(0)).cast("long").alias(f"b{s}") for s in range(subs)], F.sum("bytes").cast("long").alias("stored"))
    before = Window.partitionBy("producer").orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    size = size.withColumn("base", F.coalesce(F.sum("stored").over(before), F.lit(0)))
    ahead = lambda s: sum((F.col(f"b{k}") for k in range(s)), F.lit(0).cast("long"))
    entries = F.array(*[F.struct(F.lit(s).alias("sub"), F.when(F.col("is_broadcast"), F.col("base")).otherwise(F.col("base") + ahead(s)).alias("offset"), F.when(F.col("is_broadcast"), F.col("stored")).otherwise(F.col(f"b{s}")).alias("bytes")) for s in range(subs)])
    return size.select("producer", "region", "is_broadcast", F.explode(entries).alias("e")).select("producer", "region", "e.sub", "e.offset", "e.bytes", "is_broadcast")


def read_order(index: DataFrame, first: int, last: int) -> DataFrame:
    """Entries of subpartitions first to last in the order of the file, empty ones skipped."""
    w = Window.partitionBy("producer").orderBy("region", "sub")
    return index.filter(F.col("sub").between(first, last) & (F.col("bytes") > 0)).withColumn("nth", F.row_number().over(w).cast("long"))


def schedule(index: DataFrame) -> DataFrame:
    """The extents of all readers of a file in the order they are read: always the one next that begins first."""
    w = Window.partitionBy("producer").orderBy("offset", "sub")
    return index.filter(F.col("bytes") > 0).withColumn("turn", F.row_number().over(w).cast("long"))


def read_out(regions: DataFrame, order: list[int]) -> DataFrame:
    """Records of a region with ``nth``, their place when subpartitions are read out in ``order``; those of one keep theirs."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("sub"))
    return regions.withColumn("nth", F.row_number().over(Window.partitionBy("producer", "region").orderBy(place, "seq")).cast("long"))


def order_violations(written: DataFrame, at: str) -> DataFrame:
    """By producer, how many records fall back to a lesser subpartition within their region in the
    order of ``at``, go to all but not by the first, or are empty."""
    before = F.lag("sub").over(Window.partitionBy("producer", "region").orderBy(at))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    marked = written.withColumn("falls", ~F.col("is_broadcast") & (before > F.col("sub")))
    return marked.groupBy("producer").agg(F.count(F.lit(1)).alias("n"), n(F.col("falls")).alias("n_falling"), n(F.col("is_broadcast") & (F.col("sub") != 0)).alias("n_broadcast_elsewhere"), n(F.col("bytes") == 0).alias("n_empty"))


def violations(index: DataFrame, files: DataFrame) -> DataFrame:
    """Number of entries of each producer that break a rule of the index: ``producer, region, sub,
    is_broadcast, offset, bytes, magic`` against the sizes ``producer, file_bytes`` of the data. The
    entries of a region for all point to one place, so only the first of them follows on the entry before."""
    w = Window.partitionBy("producer").orderBy("region", "sub")
    end = F.lag(F.col("offset") + F.col("bytes")).over(w)
    first = F.row_number().over(Window.partitionBy("producer", "region").orderBy("sub")) == 1
    marked = index.withColumns({"end_": end, "first_": first}).join(files, "producer")
    broken = {
        "negative": F.col("bytes") < 0,
        "before": F.col("offset") < 0,
        "beyond": (F.col("bytes") >= 0) & (F.col("offset") + F.col("bytes") > F.col("file_bytes")),
        "magic": F.col("magic") != MAGIC,
        "gap": (~F.col("is_broadcast") | F.col("first_")) & (F.col("offset") != F.coalesce("end_", F.lit(0))),
    }
    return marked.groupBy("producer").agg(*[F.sum(c.cast("long")).alias(k) for k, c in broken.items()])


def _entry() -> Column:
    """The bytes of an entry, in hexadecimal: offset, length, magic."""
    part = lambda c, n: F.lpad(F.hex(c), n, "0")
    return F.concat(part(F.col("offset"), 16), part(F.col("bytes"), 16), part(F.lit(MAGIC), 8))


def trailer(index: DataFrame) -> DataFrame:
    """``producer, n_regions, index_bytes, crc``: what a file's index ends with when it is committed.
    An index is a few bytes for each region, held in one row."""
    regions = index.groupBy("producer", "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", _entry().alias("e")))), lambda x: x["e"]), "").alias("e"))
    files = regions.groupBy("producer").agg(F.count(F.lit(1)).alias("n_regions"), F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region", "e"))), lambda x: x["e"]), "")).alias("b"))
    return files.select("producer", "n_regions", F.octet_length("b").cast("long").alias("index_bytes"), F.crc32("b").alias("crc"))


def committed(found: DataFrame, trailers: DataFrame) -> DataFrame:
    """``producer, state``: whether an index is the one that its trailer was written for: ok, size, crc, or missing."""
    now = trailer(found).select("producer", F.col("n_regions").alias("n_"), F.col("crc").alias("crc_"))
    state = F.when(F.col("n_").isNull(), "missing").when(F.col("n_") != F.col("n_regions"), "size").when(F.col("crc_") != F.col("crc"), "crc").otherwise("ok")
    return trailers.join(now, "producer", "left").select("producer", state.alias("state"))


def with_header(df: DataFrame, payload: Column, checked: Column) -> DataFrame:
    """``bytes, magic, crc`` of a buffer; the checksum is 0 where checking is off."""
    return df.withColumns({"bytes": F.octet_length(payload).cast("long"), "magic": F.lit(MAGIC), "crc": F.when(checked, F.crc32(payload)).otherwise(F.lit(0).cast("long"))})
