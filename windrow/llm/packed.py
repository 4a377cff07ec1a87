"""Numeric arrays through a shuffle as a few large rows.

A map task deals its 64-bit keys out to buckets and sends one row for each bucket and batch, the
arrays as bytes. A reduce task gets whole buckets, so equal keys meet. That costs a fraction of a
row for each key. ``repartitionById`` gives every bucket a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = (h ^ (h >> np.uint64(30))) * K2
    h = (h ^ (h >> np.uint64(27))) * K3
    return h ^ (h >> np.uint64(31))


def packed_schema(columns: int) -> str:
    return "bucket int, " + ", ".join(f"c{k} binary" for k in range(columns))


def short(keys: np.ndarray) -> np.ndarray:
    """Half of a key, for where taking two keys for one costs work but no result."""
    return (mixed(keys) >> np.uint64(32)).astype(np.uint32)


def pack(buckets: int, keys: np.ndarray, *columns: np.ndarray, send_keys: bool = True) -> pa.RecordBatch:
    """A batch of rows ``bucket, c0, c1, ...``: keys, then the columns that go with them."""
    all_columns = (keys, *columns) if send_keys else columns
    names = ["bucket", *(f"c{k}" for k in range(len(all_columns)))]
    to = (mixed(keys) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    used, starts = np.unique(to[order], return_index=True)
    parts = [[x.tobytes() for x in np.split(c[order], starts[1:])] if len(used) else [] for c in all_columns]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], names)


def unpack(batches: Iterator[pa.RecordBatch], *types: str) -> list[np.ndarray]:
    """The arrays of all rows of a reduce task."""
    got: list[list[bytes]] = [[] for _ in types]
    for b in batches:
        for k in range(len(types)):
            got[k] += b.column(k + 1).to_pylist()
    return [np.frombuffer(b"".join(g), dtype=t) for g, t in zip(got, types, strict=True)]


def by_bucket(packed: DataFrame, buckets: int) -> DataFrame:
    return packed.repartitionById(buckets, "bucket")
