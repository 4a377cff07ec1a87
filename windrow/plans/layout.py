"""Queries over the layout of the documents as records of producers (their languages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrow.operators import layout
from windrow.registry import query
from windrow.sources.tables import table

SUBS, CAPACITY, BUFFER = 4, 60_000, 16_384


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th document and the two that follow go to all subpartitions."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("producer"), F.col("doc_id").alias("seq"), (F.col("doc_id") % SUBS).cast("int").alias("sub"),
        (F.col("doc_id") % 20 < 3).alias("is_broadcast"), F.octet_length("text").cast("long").alias("bytes"),
    )


_RECORDS = f"""
rec AS (
  SELECT lang AS producer, doc_id AS seq, CAST(doc_id % {SUBS} AS INT) AS sub, doc_id % 20 < 3 AS is_broadcast, CAST(octet_length(encode(text)) AS BIGINT) AS bytes,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents)"""
_REGIONS = f"""{_RECORDS},
walk AS (
  SELECT producer, seq, sub, is_broadcast, bytes, i, CAST(0 AS BIGINT) AS region, bytes + {layout.ENTRY_BYTES} AS used FROM rec WHERE i = 1
  UNION ALL
  SELECT r.producer, r.seq, r.sub, r.is_broadcast, r.bytes, r.i,
    w.region + CASE WHEN r.is_broadcast <> w.is_broadcast OR w.used + r.bytes + {layout.ENTRY_BYTES} > {CAPACITY} THEN 1 ELSE 0 END,
    CASE WHEN r.is_broadcast <> w.is_broadcast OR w.used + r.bytes + {layout.ENTRY_BYTES} > {CAPACITY} THEN 0 ELSE w.used END + r.bytes + {layout.ENTRY_BYTES}
  FROM walk w JOIN rec r ON r.producer = w.producer AND r.i = w.i + 1)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.greedy_groups(records(spark, sf_dir), ["producer"], ["seq"], "bytes", CAPACITY, mode="is_broadcast", entry=layout.ENTRY_BYTES, col="region")


@query("region_assign", f"WITH RECURSIVE {_REGIONS} SELECT producer, seq, region FROM walk")
def region_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select("producer", "seq", "region")


_SIZES = f"""{_REGIONS},
size AS (
  SELECT producer, region, bool_or(is_broadcast) AS is_broadcast, CAST(sum(bytes) AS BIGINT) AS stored FROM walk GROUP BY producer, region),
base AS (
  SELECT *, CAST(coalesce(sum(stored) OVER (PARTITION BY producer ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM size),
grid AS (
  SELECT b.producer, b.region, b.is_broadcast, b.base, b.stored, s.sub,
    CAST(coalesce((SELECT sum(w.bytes) FROM walk w WHERE w.producer = b.producer AND w.region = b.region AND w.sub = s.sub), 0) AS BIGINT) AS own
  FROM base b, (SELECT CAST(unnest(range(0, {SUBS})) AS INT) AS sub) s),
idx AS (
  SELECT producer, region, sub, is_broadcast,
    CASE WHEN is_broadcast THEN base ELSE CAST(base + coalesce(sum(own) OVER (PARTITION BY producer, region ORDER BY sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS "offset",
    CASE WHEN is_broadcast THEN stored ELSE own END AS bytes FROM grid)"""


@query("region_index", f'WITH RECURSIVE {_SIZES} SELECT producer, region, sub, "offset", bytes FROM idx WHERE NOT is_broadcast')
def region_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.region_index(regions(spark, sf_dir), SUBS).filter("not is_broadcast").drop("is_broadcast")


@query("broadcast_region_index", f'WITH RECURSIVE {_SIZES} SELECT producer, region, sub, "offset", bytes FROM idx WHERE is_broadcast')
def broadcast_region_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.region_index(regions(spark, sf_dir), SUBS).filter("is_broadcast").drop("is_broadcast")


@query(
    "range_read",
    f'WITH RECURSIVE {_SIZES} SELECT producer, region, sub, "offset", bytes, row_number() OVER (PARTITION BY producer ORDER BY region, sub) AS nth FROM idx WHERE sub BETWEEN 1 AND 2 AND bytes > 0',
)
def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.read_order(layout.region_index(regions(spark, sf_dir), SUBS), 1, 2).drop("is_broadcast")


_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i))"


_CRC = f"crc AS (SELECT {_CRC_TABLE} AS rest)"


def crc_sql(blob: str) -> str:
    """CRC-32 of a blob in SQL, a byte at a time by the table of remainders in ``_CRC``."""
    byte = f"CAST('0x' || hex({blob}[k + 1:k + 1]) AS BIGINT)"
    step = "lambda c, k: xor(c // 256, rest[xor(c % 256, k) + 1])"
    return f"xor(list_reduce(list_transform(range(octet_length({blob})), lambda k: {byte}), {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


_BROKEN = f"""{_SIZES},
broken AS (
  SELECT producer, region, sub, is_broadcast, CASE WHEN region % 7 = 3 AND sub = 1 THEN "offset" + 1 ELSE "offset" END AS "offset",
    CASE WHEN region % 11 = 5 AND sub = 2 THEN -1 - bytes WHEN region % 6 = 4 AND sub = 0 THEN bytes + 100000000 ELSE bytes END AS bytes,
    CASE WHEN region % 5 = 2 AND sub = 3 THEN 0 ELSE {layout.MAGIC} END AS magic FROM idx)"""


@query(
    "index_violations",
    f"""
    WITH RECURSIVE {_BROKEN},
    file AS (SELECT producer, CAST(sum(stored) AS BIGINT) AS file_bytes FROM size GROUP BY producer),
    reg AS (
      SELECT producer, region, min("offset") AS lo, max(CASE WHEN is_broadcast THEN "offset" + bytes END) AS b_end, sum(CASE WHEN is_broadcast THEN 0 ELSE bytes END) AS own,
        bool_or(is_broadcast) AS b FROM broken GROUP BY producer, region),
    seen AS (
      SELECT k.*, file_bytes, lag(k."offset" + k.bytes) OVER (PARTITION BY k.producer ORDER BY k.region, k.sub) AS prev_end,
        row_number() OVER (PARTITION BY k.producer, k.region ORDER BY k.sub) AS nth FROM broken k JOIN file f ON f.producer = k.producer)
    SELECT producer, CAST(sum((bytes < 0)::INT) AS BIGINT) AS negative, CAST(sum(("offset" < 0)::INT) AS BIGINT) AS before,
      CAST(sum((bytes >= 0 AND "offset" + bytes > file_bytes)::INT) AS BIGINT) AS beyond, CAST(sum((magic <> {layout.MAGIC})::INT) AS BIGINT) AS magic,
      CAST(sum(((NOT is_broadcast OR nth = 1) AND "offset" <> coalesce(prev_end, 0))::INT) AS BIGINT) AS gap
    FROM seen GROUP BY producer
    """,
)
def index_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = layout.region_index(regions(spark, sf_dir), SUBS)
    r, s = F.col("region"), F.col("sub")
    broken = index.withColumns({
        "offset": F.when((r % 7 == 3) & (s == 1), F.col("offset") + 1).otherwise(F.col("offset")),
        "bytes": F.when((r % 11 == 5) & (s == 2), -1 - F.col("bytes")).when((r % 6 == 4) & (s == 0), F.col("bytes") + 100_000_000).otherwise(F.col("bytes")),
        "magic": F.when((r % 5 == 2) & (s == 3), 0).otherwise(F.lit(layout.MAGIC)),
    })
    files = records(spark, sf_dir).groupBy("producer").agg(F.sum("bytes").alias("file_bytes"))
    return layout.violations(broken, files)


@query(
    "index_trailer",
    f"""
    WITH RECURSIVE {_SIZES}, {_CRC},
    entry AS (SELECT producer, region, sub, printf('%016x', "offset") || printf('%016x', bytes) || printf('%08x', {layout.MAGIC}) AS e FROM idx),
    reg AS (SELECT producer, region, string_agg(e, '' ORDER BY sub) AS e FROM entry GROUP BY producer, region),
    file AS (SELECT producer, count(*) AS n_regions, unhex(string_agg(e, '' ORDER BY region)) AS b FROM reg GROUP BY producer)
    SELECT producer, n_regions, CAST(octet_length(b) AS BIGINT) AS index_bytes, {crc_sql('b')} AS crc FROM file, crc
    """,
)
def index_trailer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.trailer(layout.region_index(regions(spark, sf_dir), SUBS))


@query(
    "index_commit_check",
    f"""
    WITH RECURSIVE {_SIZES}, file AS (SELECT producer, count(DISTINCT region) AS n FROM idx GROUP BY producer)
    SELECT producer, CASE WHEN producer = 'de' THEN 'size' WHEN producer = 'fr' THEN 'crc' ELSE 'ok' END AS state FROM file
    """,
)
def index_commit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index has lost its last region, another has a changed entry; the trailers tell."""
    index = layout.region_index(regions(spark, sf_dir), SUBS)
    last = F.max("region").over(Window.partitionBy("producer"))
    found = index.withColumn("last", last).filter("producer <> 'de' or region < last").withColumn("bytes", F.when((F.col("producer") == "fr") & (F.col("region") == 0) & (F.col("sub") == 1), F.col("bytes") + 1).otherwise(F.col("bytes")))
    return layout.committed(found.drop("last"), layout.trailer(index))


@query(
    "read_schedule",
    f"""
    WITH RECURSIVE {_SIZES}
    SELECT producer, sub, region, "offset", row_number() OVER (PARTITION BY producer ORDER BY "offset", sub) AS turn FROM idx WHERE bytes > 0
    """,
)
def read_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subpartition has a reader; the one whose next extent begins first is served, until all are read."""
    return layout.schedule(layout.region_index(regions(spark, sf_dir), SUBS)).select("producer", "sub", "region", "offset", "turn")


_PACK = f"""{_REGIONS},
line AS (SELECT *, row_number() OVER (PARTITION BY producer, region ORDER BY {{order}}) AS j FROM walk),
pack AS (
  SELECT producer, region, sub, bytes, j, CAST(0 AS BIGINT) AS buffer, bytes AS used2 FROM line WHERE j = 1
  UNION ALL
  SELECT r.producer, r.region, r.sub, r.bytes, r.j, w.buffer + CASE WHEN r.sub <> w.sub OR w.used2 + r.bytes > {BUFFER} THEN 1 ELSE 0 END,
    CASE WHEN r.sub <> w.sub OR w.used2 + r.bytes > {BUFFER} THEN 0 ELSE w.used2 END + r.bytes
  FROM pack w JOIN line r ON r.producer = w.producer AND r.region = w.region AND r.j = w.j + 1)
SELECT producer, region, sub, buffer, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS n FROM pack GROUP BY producer, region, sub, buffer
"""


def _packed(spark: SparkSession, sf_dir: str, *order: str) -> DataFrame:
    """Buffers of records in that order: one ends where the next record is for another subpartition
    or doesn't fit, and at the end of each region."""
    packed = layout.greedy_groups(regions(spark, sf_dir), ["producer", "region"], list(order), "bytes", BUFFER, mode="sub", col="buffer")
    return packed.groupBy("producer", "region", "sub", "buffer").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))


@query("buffer_pack", f"WITH RECURSIVE {_PACK.format(order='sub, seq')}")
def buffer_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, "sub", "seq")


@query("buffer_pack_as_they_come", f"WITH RECURSIVE {_PACK.format(order='seq')}")
def buffer_pack_as_they_come(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, "seq")


@query(
    "buffer_crc32",
    f"""
    WITH {_CRC}
    SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS bytes, {layout.MAGIC} AS magic, CASE WHEN doc_id % 2 = 0 THEN {crc_sql('b')} ELSE 0 END AS crc
    FROM (SELECT doc_id, encode(CASE WHEN doc_id % 10 = 0 THEN text ELSE left(text, 40) END) AS b FROM documents) t, crc
    """,
)
def buffer_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of buffers: each tenth text whole, of the others the first buffer; every other one without a checksum."""
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.col("text")).otherwise(F.left("text", F.lit(40))).cast("binary").alias("b"))
    return layout.with_header(d, F.col("b"), F.col("doc_id") % 2 == 0).drop("b")


_READ_ORDER = (2, 0, 3, 1)


@query(
    "write_order_check",
    f"""
    WITH RECURSIVE {_REGIONS},
    o AS (SELECT producer, region, sub, is_broadcast, bytes, lag(sub) OVER (PARTITION BY producer, region ORDER BY seq) AS prev FROM walk)
    SELECT producer, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum((NOT is_broadcast AND prev > sub)::INT), 0) AS BIGINT) AS n_falling,
      CAST(sum((is_broadcast AND sub <> 0)::INT) AS BIGINT) AS n_broadcast_elsewhere, CAST(sum((bytes = 0)::INT) AS BIGINT) AS n_empty, CAST(0 AS BIGINT) AS n_falling_sorted
    FROM o GROUP BY producer
    """,
)
def write_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as they come break the rule; read out of the sort buffer by subpartition, they keep it."""
    r = regions(spark, sf_dir)
    out = layout.read_out(r, list(range(SUBS)))
    kept = layout.order_violations(out, "nth").select("producer", F.col("n_falling").alias("n_falling_sorted"))
    return layout.order_violations(r, "seq").join(kept, "producer")


@query(
    "sort_buffer_read_order",
    f"""
    WITH RECURSIVE {_REGIONS}
    SELECT producer, region, sub, seq, row_number() OVER (PARTITION BY producer, region ORDER BY CASE sub {' '.join(f'WHEN {s} THEN {k}' for k, s in enumerate(_READ_ORDER))} END, seq) AS nth FROM walk
    """,
)
def sort_buffer_read_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.read_out(regions(spark, sf_dir), list(_READ_ORDER)).select("producer", "region", "sub", "seq", "nth")
