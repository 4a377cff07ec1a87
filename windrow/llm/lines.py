"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of ascending ids. The distinct line hashes of a batch are merge-anti-
joined with the runs so far: tables bucketed by hash and sorted within buckets, so that only the
batch is shuffled. What is left is new and becomes a run of level 0 with the smallest id that
holds each line; when a level has ``FANOUT`` runs they are compacted into one run of the next
level. A line of the batch stays where its (hash, id) is in the batch's own run.

A hot line is one row for each task in the grouping by hash; the join that finds its other
holders is an ordinary one that Spark splits when it is skewed.

Defined results: null or empty text is one empty line; lines are compared by 128 bits of the
SHA-256 of their key; rows that repeat an id are one document; a null id comes after all others;
an empty table gives no rows; other columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import bucketed, partitions, save, saved, small_batches
from windrow.sources.scratch import tidied
from windrow.sources.tables import table

LEAST_CHARS = 10
BATCHES = 6
FANOUT = 3

_BLANK = b" \t\n\v\f\r"


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z in lower case (other letters stay)."""
    return line.strip(_BLANK).lower()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


class Runs:
    """Sorted runs ``hash, owner`` by level, in tables bucketed by hash."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout, self.levels = spark, fanout, {}
        self.buckets = partitions(spark)

    def write(self, run: DataFrame) -> tuple[str, str]:
        return bucketed(run.repartition(self.buckets, "hash"), "run", self.buckets, "hash")

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """``hashes`` less those that a run holds."""
        for level in self.levels.values():
            for name, _ in level:
                hashes = hashes.join(self.spark.table(name).hint("merge"), "hash", "left_anti")
        return hashes

    def add(self, hashes: DataFrame) -> str:
        """Write the unseen of ``hash, owner`` as a run and return its path; compact when due."""
        name, path = self.write(self.unseen(hashes))
        self.levels.setdefault(0, []).append((name, path))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            tables = [self.spark.table(n) for n, _ in self.levels[level]]
            merged = tables[0]
            for t in tables[1:]:
                merged = merged.unionAll(t)
            self.levels.setdefault(level + 1, []).append(self.write(merged))
            self.levels[level] = []
            level += 1
        return path


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, batches: int = BATCHES, fanout: int = FANOUT, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``id, row, drops``: for each document that loses lines, their numbers in order."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    bounds = d.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000).alias("q")).first()["q"] or []

    def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, rows, at, hs = [], [], [], []
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for i, r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                for k, line in enumerate((t or b"").split(b"\n")):
                    if _long(key := line_key(line), least_chars):
                        ids.append(i)
                        rows.append(r)
                        at.append(k)
                        hs.append(hashlib.sha256(key).digest()[:16])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(at, pa.int32()), pa.array(hs, pa.binary())], ["id", "row", "at", "hash"])

    lines = d.mapInArrow(hashes, "id long, row long, at int, hash binary")
    nth = F.lit(0)
    for b in sorted(set(bounds)):
        nth = nth + F.coalesce(F.col("id") > b, F.lit(True)).cast("int")
    lines = saved(lines.withColumn("batch", nth), "lines", "batch")
    runs, out = Runs(spark, fanout), []
    for k in range(len(set(bounds)) + 1):
        batch = lines.filter(F.col("batch") == k)
        own = runs.add(batch.groupBy("hash").agg(F.min("id").alias("owner")))
        # Only documents without an id hold what a null owns, since the least id is an id if there is one.
        owned = spark.read.schema("hash binary, owner long").parquet(own).withColumnRenamed("hash", "own")
        gone = batch.join(owned, (F.col("hash") == F.col("own")) & F.col("id").eqNullSafe(F.col("owner")), "left_anti")
        out.append(save(gone.groupBy("id", "row").agg(F.sort_array(F.collect_set("at")).alias("drops")), "dropped-lines"))
    return spark.read.schema("id long, row long, drops array<int>").parquet(*out)


def _without(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
    out = []
    for t, gone in zip(text, drops, strict=True):
        lines = (t or "").split("\n")
        gone = () if gone is None else set(gone.tolist())
        out.append(("\n".join([x for k, x in enumerate(lines) if k not in gone]) if gone else t or "", len(lines), len(gone)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


@tidied
def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """``docs`` as structs ``doc`` with ``text, n_lines, n_dropped``: the text that is left."""
    drops = dropped_lines(docs, id_col, text_col, **options)
    d = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("id_"), F.xxhash64(text_col).alias("row_"), F.col(text_col).alias("text_"))
    joined = d.join(drops, d["id_"].eqNullSafe(drops["id"]) & (d["row_"] == drops["row"]), "left")
    without = F.pandas_udf(_without, "text string, n_lines long, n_dropped long")
    return joined.select("doc", without("text_", "drops").alias("r")).select("doc", "r.*")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.i, k.line, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
