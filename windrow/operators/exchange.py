"""Explicit redistribution of rows. Physical partition numbers never show in results."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_hash(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)


def rebalance(df: DataFrame, n: int) -> DataFrame:
    """Round robin."""
    return df.repartition(n)


def rescale(df: DataFrame, n: int, grow: bool = False) -> DataFrame:
    """At most ``n`` partitions without a shuffle; or, with ``grow``, as many with one."""
    return df.repartition(n) if grow else df.coalesce(n)


def route(df: DataFrame, n: int, to: str) -> DataFrame:
    """Every row to the partition whose number is in the column ``to``."""
    return df.repartitionById(n, to)


def to_all(df: DataFrame, n: int, col: str = "task") -> DataFrame:
    """A copy of every row for each of ``n`` receivers."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(col))


def read_range(df: DataFrame, col: str, first: int, last: int) -> DataFrame:
    """The rows of subpartitions ``first`` to ``last``, both included."""
    return df.filter(F.col(col).between(first, last))


def sent_and_produced(df: DataFrame, size: Column, to_every: Column, receivers: int) -> DataFrame:
    """Bytes that leave, with a copy for each receiver of what goes to all, and bytes made."""
    copies = F.when(to_every, F.lit(receivers)).otherwise(F.lit(1))
    return df.agg(F.sum(size * copies).cast("long").alias("bytes_out"), F.sum(size).cast("long").alias("bytes_produced"), F.count(F.lit(1)).alias("n_buffers"))


def compressed(buffers: DataFrame, id_col: str = "id", payload_col: str = "payload") -> DataFrame:
    """``id, stored, is_compressed``: buffers compressed one by one, and left as they are where that doesn't make them smaller."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            tried = [None if x is None else zlib.compress(x, 1) for x in raw]
            smaller = [x is not None and len(y) < len(x) for x, y in zip(raw, tried, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([y if s else x for x, y, s in zip(raw, tried, smaller, strict=True)], pa.binary()), pa.array(smaller)], ["id", "stored", "is_compressed"])

    return buffers.select(F.col(id_col).cast("long").alias("id"), F.col(payload_col).alias("payload")).mapInArrow(f, "id long, stored binary, is_compressed boolean")


def decompressed(buffers: DataFrame) -> DataFrame:
    """``id, payload`` of what ``compressed`` has stored."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [zlib.decompress(x) if s else x for x, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "payload"])

    return buffers.select("id", "stored", "is_compressed").mapInArrow(f, "id long, payload binary")


def in_order(df: DataFrame, key: str, order: list[str], columns: list[str], out: str, start: object, step: Callable) -> DataFrame:
    """``df`` with whole-number columns that hang on all rows of a key before: ``step(state, *columns)``
    gives the next state and the row's values. Rows are sorted within partitions and streamed, so a key of any length
    needs constant memory."""
    names = [x.split()[0] for x in out.split(",")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, start
        for b in batches:
            rows = []
            for k, *values in zip(b[key].tolist(), *(b[c].tolist() for c in columns), strict=True):
                if k != now:
                    now, state = k, start
                state, made = step(state, *values)
                rows.append(made)
            yield b.assign(**{n: pd.array([r[i] for r in rows], dtype="Int64") for i, n in enumerate(names)})

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(go, f"{fields}, {out}")


def opened(channels: DataFrame, most: int) -> DataFrame:
    """``gate, turn, takes`` with ``opens, closes``: at most that many channels of a gate are open; the next one opens when one closes."""

    def step(ends: tuple[int, ...], takes: int) -> tuple[tuple[int, ...], tuple[int, int]]:
        begins = ends[0]
        return tuple(sorted((*ends[1:], begins + takes))), (begins, begins + takes)

    return in_order(channels, "gate", ["turn", "takes"], ["takes"], "opens long, closes long", (0,) * most, step)


def granted(requests: DataFrame, buffers: int) -> DataFrame:
    """``pool, seq, least, most`` with ``granted``: buffers go to requests in turn, up to ``most`` and ``least`` at
    least; one that can't be met waits, and all behind it (null)."""

    def step(left: int, least: int, most: int) -> tuple[int, tuple[int | None]]:
        if left < least:
            return -1, (None,)
        n = min(left, most)
        return left - n, (n,)

    return in_order(requests, "pool", ["seq", "most"], ["least", "most"], "granted long", buffers, step)
