"""Exact dedup by content-defined chunk recipes.

A text, normalised, is cut where a rolling hash of the last 32 bytes says so, which makes equal
texts equal lists of chunks. Each distinct chunk is moved once, with copies dropped before the
shuffle, to verify that its digest names it alone; where a digest names several contents they
are numbered. From there only recipes, the ordered lists of identifiers, are compared.

A group of copies that holds a third of all rows is one row for each task in the grouping. Groups
of more than a ``MOST_HOT``-th of all rows, of which there are fewer than ``MOST_HOT``, return to
their rows by broadcast; the others by a join without a hot key.

Defined results: null text counts as empty; the empty text has the empty recipe; of rows that
repeat an id with equal texts all are kept rows of that id (``kept`` tells id = keep_id); a null
id is never the smallest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.llm.common import SPACE, saved, small_batches
from windrow.sources.scratch import tidied
from windrow.sources.tables import table

#: Least, usual and largest bytes of a chunk; the usual size is a power of two.
LEAST, USUAL, MOST = 256, 1024, 8192
DIGEST_BYTES = 16
#: Bytes of chunks that a task remembers to drop copies before the shuffle.
REMEMBER = 32 << 20
#: Bound on the groups that are broadcast.
MOST_HOT = 1000

_GEAR = np.frombuffer(hashlib.shake_256(b"gear").digest(256 * 8), dtype="<u8").copy()


def cuts(b: bytes, least: int = LEAST, usual: int = USUAL, most: int = MOST) -> list[int]:
    """Ends of the chunks of ``b``; they depend on the content around them only."""
    n = len(b)
    if n <= least:
        return [n] if n else []
    h = _GEAR[np.frombuffer(b, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):  # h[i] = sum of gear[b[i - j]] << j over the last 32 bytes
        h[step:] += h[:-step] << np.uint64(step)
    at = np.flatnonzero((h >> np.uint64(24)) & np.uint64(usual - 1) == 0) + 1
    out, last = [], 0
    for p in at.tolist():
        while p - last > most:
            last += most
            out.append(last)
        if p - last >= least and p < n:
            out.append(p)
            last = p
    while n - last > most:
        last += most
        out.append(last)
    return [*out, n]


def chunks(b: bytes) -> list[bytes]:
    ends = cuts(b)
    return [b[s:e] for s, e in zip([0, *ends], ends, strict=False)]


def _digest(c: bytes, size: int) -> bytes:
    return hashlib.blake2b(c, digest_size=16).digest()[:size]


def _normal(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ").cast("binary").alias("b"))


@tidied
def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """A row for each document: ``id, keep_id, group_size, kept, text_sha256``."""
    small_batches(docs.sparkSession)
    normal = _normal(docs, id_col, text_col)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            ds, cs = [], []
            for b in batch.column(0).to_pylist():
                for c in chunks(b):
                    d = _digest(c, digest_bytes)
                    if seen.get(d) != c:
                        ds.append(d)
                        cs.append(c)
                        if held < REMEMBER:
                            held += len(c)
                            seen.setdefault(d, c)
            yield pa.RecordBatch.from_arrays([pa.array(ds, pa.binary()), pa.array(cs, pa.binary())], ["digest", "content"])

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bs = batch.column(1).to_pylist()
            rs = [b"".join(_digest(c, digest_bytes) for c in chunks(b)) for b in bs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rs, pa.binary()), pa.array([hashlib.sha256(b).hexdigest() for b in bs])], ["id", "recipe", "text_sha256"])

    distinct = normal.select("b").mapInArrow(contents, "digest binary, content binary").distinct()
    shared = saved(distinct.groupBy("digest").count().filter("count > 1").select("digest"), "shared-digests")
    rows = normal.mapInArrow(recipes, "id long, recipe binary, text_sha256 string")
    rows = saved(rows, "recipes") if shared.isEmpty() else _numbered(normal, distinct, shared, rows, digest_bytes)
    groups = rows.groupBy("recipe").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    hot = groups.filter(F.col("group_size") * MOST_HOT > rows.count())
    hot = hot.select(F.sha2("recipe", 256).alias("name"), F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    marked = rows.join(F.broadcast(hot), F.sha2(rows["recipe"], 256) == F.col("name"), "left")
    found = marked.filter(F.col("name").isNotNull()).select("id", "text_sha256", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"))
    rest = marked.filter(F.col("name").isNull()).join(groups, "recipe").select("id", "text_sha256", "keep_id", "group_size")
    return found.unionAll(rest).select("id", "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def _numbered(normal: DataFrame, distinct: DataFrame, shared: DataFrame, rows: DataFrame, digest_bytes: int) -> DataFrame:
    """Recipes whose identifiers tell apart the contents that share a digest."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sha = hashlib.sha256(b).hexdigest()
                out += [(i, sha, k, _digest(c, digest_bytes), c) for k, c in enumerate(chunks(b))]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["id", "text_sha256", "k", "digest", "content"])

    nth = F.row_number().over(Window.partitionBy("digest").orderBy("content"))
    named = distinct.join(shared, "digest", "left_semi").withColumn("nth", nth)
    named = saved(named, "numbered-chunks")
    parts = normal.mapInArrow(pieces, "id long, text_sha256 string, k long, digest binary, content binary")
    ids = parts.join(named, ["digest", "content"], "left").select("id", "text_sha256", "k", F.concat("digest", F.lit(b"#"), F.coalesce("nth", F.lit(0)).cast("string").cast("binary"), F.lit(b";")).alias("chunk"))
    lists = ids.groupBy("id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("k", "chunk"))).alias("list"))
    lists = lists.select(F.col("id").alias("id2"), F.col("text_sha256").alias("sha2"), F.unhex(F.array_join(F.transform("list", lambda x: F.hex(x["chunk"])), "")).alias("recipe2"))
    whole = rows.join(lists, rows["id"].eqNullSafe(lists["id2"]) & (rows["text_sha256"] == lists["sha2"]), "left")
    return saved(whole.select("id", F.coalesce("recipe2", F.lit(b"")).alias("recipe"), "text_sha256"), "recipes")


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)
"""
