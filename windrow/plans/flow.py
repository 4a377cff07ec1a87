"""Dataflow queries: word counts, distinct, union, joins, checksums, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.operators import flow
from windrow.registry import query
from windrow.sources import files, schemas
from windrow.sources.scratch import scratch, scratch_table, tidy
from windrow.sources.tables import table

NARROW = ("l_returnflag", "l_linestatus", "l_quantity")
STAR_NARROW = ("p_brand", "o_orderpriority", "l_returnflag")
#: Sizes of the word-count job: words, copies of each, and the tasks that all of them reach.
LAST_WORD, COPIES, TASKS = 20, 200, 16


@query(
    "word_count",
    """
    SELECT word, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\W+')) AS word FROM documents) t
    WHERE word <> '' GROUP BY word
    """,
)
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.words(table(spark, sf_dir, "documents")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "word_count_union_inputs",
    """
    SELECT word, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\W+')) AS word
          FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT text FROM benchmark) u) t
    WHERE word <> '' GROUP BY word
    """,
)
def word_count_union_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = flow.union_all(*(table(spark, sf_dir, t).select("text") for t in ("documents", "conversations", "benchmark")))
    return flow.keyed_sum(flow.words(texts), "word", F.lit(1), "n")


@query(
    "replicate_flatmap",
    f"""
    SELECT 'WORD-' || i || '-suffix' AS word, CAST({COPIES * TASKS} AS BIGINT) AS n
    FROM (SELECT unnest(range(0, {LAST_WORD + 1})) AS i) t
    """,
)
def replicate_flatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = files.sequence(spark, 0, LAST_WORD).select(F.concat(F.lit("WORD-"), F.col("id").cast("string"), F.lit("-suffix")).alias("word"))
    everywhere = named.join(F.broadcast(spark.range(TASKS).withColumnRenamed("id", "task")), F.lit(True))  # TASKS rows
    return flow.multiplicity(flow.replicate(everywhere, COPIES), "word")


@query("distinct_count", "SELECT CAST(count(1) AS BIGINT) AS res FROM (SELECT DISTINCT * FROM lineitem) t")
def distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.count_all(table(spark, sf_dir, "lineitem").distinct(), "res")


@query("distinct_count_narrow", f"SELECT CAST(count(1) AS BIGINT) AS res FROM (SELECT DISTINCT {', '.join(NARROW)} FROM lineitem) t")
def distinct_count_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.count_all(table(spark, sf_dir, "lineitem").select(*NARROW).distinct(), "res")


_UNION = " UNION ".join(["SELECT * FROM lineitem"] * 4)


@query("union_distinct_count", f"SELECT CAST(count(1) AS BIGINT) AS res FROM ({_UNION}) t")
def union_distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return flow.count_all(flow.union_distinct(li, li, li, li), "res")


@query("union_distinct_narrow", f"SELECT DISTINCT {', '.join(NARROW)} FROM lineitem")
def union_distinct_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(*NARROW)
    return flow.union_distinct(li, li, li, li)


@query("union_all_multiplicity", "SELECT o_custkey, CAST(2 * count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey")
def union_all_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey")
    return flow.multiplicity(flow.union_all(o, o), "o_custkey")


@query("sequence_multiplicity", "SELECT i AS id, CAST(2 AS BIGINT) AS n FROM (SELECT unnest(range(0, 10000)) AS i) t")
def sequence_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.multiplicity(flow.union_all(files.sequence(spark, 0, 9_999), files.sequence(spark, 0, 9_999)), "id")


def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.star(table(spark, sf_dir, "lineitem"), (table(spark, sf_dir, "part"), "l_partkey", "p_partkey"), (table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey"))


_STAR = "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"


@query("star_join_distinct_count", f"SELECT CAST(count(1) AS BIGINT) AS res FROM (SELECT DISTINCT * {_STAR}) t")
def star_join_distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.count_all(_star(spark, sf_dir).distinct(), "res")


@query("star_join_narrow_distinct", f"SELECT DISTINCT {', '.join(STAR_NARROW)} {_STAR}")
def star_join_narrow_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _star(spark, sf_dir).select(*STAR_NARROW).distinct()


@query("star_join_totals", f"SELECT p_brand, o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines {_STAR} GROUP BY p_brand, o_orderpriority")
def star_join_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _star(spark, sf_dir).groupBy("p_brand", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


_CHAIN = """
SELECT CAST(sum((f0 + f1) % 77777) % 77777 AS BIGINT) AS checksum, CAST(count(*) AS BIGINT) AS n_rows FROM (
  SELECT a * 2 % 99999 AS f0, b * 3 % 99999 AS f1 FROM (
    SELECT a * 2 % 99999 AS a, b * 3 % 99999 AS b FROM (
      SELECT a * 2 % 99999 AS a, b * 3 % 99999 AS b FROM ({source}) s) t) u) v
"""


@query("mod_chain_checksum", _CHAIN.format(source="SELECT i AS a, i + 1 AS b FROM (SELECT unnest(range(1, 3000001)) AS i) r"))
def mod_chain_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = files.sequence(spark, 1, 3_000_000).select(F.col("id").alias("f0"), (F.col("id") + 1).alias("f1"))
    return flow.checksum(flow.mod_chain(pairs, int(spark.conf.get("spark.sql.shuffle.partitions"))))


@query("mod_chain_on_orders", _CHAIN.format(source="SELECT o_orderkey AS a, o_custkey AS b FROM orders"))
def mod_chain_on_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("f0"), F.col("o_custkey").alias("f1"))
    return flow.checksum(flow.mod_chain(pairs, int(spark.conf.get("spark.sql.shuffle.partitions"))))


@query(
    "csv_parse_errors",
    """
    SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS price, p_brand AS brand
    FROM part
    """,
)
def csv_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("p_partkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string"))
    lines = table(spark, sf_dir, "part").select(F.concat_ws(files.DELIMITER, F.col("p_partkey").cast("string"), price, F.col("p_brand")).alias("value"))
    return lines.select(files.parse_delimited(F.col("value"), "k long, price double, brand string").alias("r")).select("r.*")


@query("csv_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = scratch(spark, "orders-csv")
    files.write_delimited(o, path)
    return files.read_delimited(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@query(
    "text_round_trip",
    "SELECT '(' || n_name || ',' || n_regionkey || ')' AS value FROM nation UNION ALL SELECT '(' || r_name || ',' || r_regionkey || ')' FROM region",
)
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = scratch(spark, "nation-text"), scratch(spark, "region-text")
    files.write_text(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), a)
    files.write_text(table(spark, sf_dir, "region").select("r_name", "r_regionkey"), b)
    return files.read_text(spark, a, b)


@query("insert_select", "SELECT CAST(count(1) AS BIGINT) AS res FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem) t UNION ALL SELECT CAST(count(1) AS BIGINT) FROM orders")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tidy():
        name, path = scratch_table(spark, "result-table")
        spark.sql(f"CREATE TABLE {name} (res BIGINT) USING parquet LOCATION '{path}'")
        views = {t: f"{name}_{t}" for t in ("lineitem", "orders")}
        for t, v in views.items():
            table(spark, sf_dir, t).createOrReplaceTempView(v)
        spark.sql(f"INSERT INTO {name} SELECT count(1) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM {views['lineitem']}) t")
        spark.sql(f"INSERT INTO {name} SELECT count(1) FROM {views['orders']}")
        for v in views.values():
            spark.catalog.dropTempView(v)
    return spark.read.schema("res long").parquet(path)


@query(
    "byte_records",
    """
    SELECT CAST(s AS BIGINT) AS source, CAST(count(*) AS BIGINT) AS n_records, CAST(count(DISTINCT i) AS BIGINT) AS n_distinct, CAST(sum(1024) AS BIGINT) AS n_bytes,
      min(left(sha256(i || '-0'), 16)) AS least
    FROM (SELECT unnest(range(0, 4)) AS s) a, (SELECT unnest(range(0, 1024)) AS i) b GROUP BY s
    """,
)
def byte_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = files.byte_records(spark, sources=4, records=1024, distinct=1024).repartition(4)
    return r.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_records"), F.countDistinct("record").alias("n_distinct"), F.sum(F.octet_length("record")).cast("long").alias("n_bytes"),
        F.min(F.lower(F.substring(F.hex("record"), 1, 16))).alias("least"),
    )


@query("collection_source", "SELECT word, CAST(n AS BIGINT) AS n FROM (VALUES ('to', 2), ('be', 2), ('or', 1), ('not', 1)) t(word, n)")
def collection_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = files.collection(spark, [("To be, or not",), ("to be",)], "text string")
    return flow.keyed_sum(flow.words(lines), "word", F.lit(1), "n")


@query("counting_sink", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders")
def counting_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are discarded; what was observed on their way tells how many they were."""
    d, seen = flow.observed_count(table(spark, sf_dir, "orders").select("o_orderkey"))
    files.discard(d)
    return spark.createDataFrame([(seen.get["n"],)], "n long")


@query("declared_tables", "SELECT tbl, CAST(n AS BIGINT) AS n_columns, first, last FROM (VALUES ('result_table', 1, 'res', 'res'), ('store_sales', 23, 'ss_sold_date_sk', 'ss_net_profit'), ('web_sales', 34, 'ws_sold_date_sk', 'ws_net_profit'), ('item', 22, 'i_item_sk', 'i_product_name'), ('date_dim', 28, 'd_date_sk', 'd_current_year')) t(tbl, n, first, last)")
def declared_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tables are created over empty folders, and what the catalogue then knows of them."""
    out = []
    with tidy():
        for kind in schemas.TABLES:
            name, path = scratch_table(spark, kind)
            schemas.create_table(spark, kind, name, path)
            fields = spark.table(name).schema.fields
            out.append((kind, len(fields), fields[0].name, fields[-1].name))
    return spark.createDataFrame(out, "tbl string, n_columns long, first string, last string")


@query(
    "declared_star_count",
    "SELECT CAST(count(1) AS BIGINT) AS res FROM (SELECT DISTINCT l_partkey, l_orderkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS price, p_brand, o_orderpriority FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) t",
)
def declared_star_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as delimited files under the declared schemas, read through their tables, joined, and counted into the declared sink."""

    def rows(kind: str, source: str, **columns: Column) -> DataFrame:
        names = [c.split()[0] for c in schemas.TABLES[kind].split(",")]
        return table(spark, sf_dir, source).select(*[columns.get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in names])

    made = {
        "store_sales": rows("store_sales", "lineitem", ss_item_sk=F.col("l_partkey"), ss_sold_date_sk=F.col("l_orderkey"), ss_sales_price=F.when(F.col("l_linenumber") == 3, F.lit("n/a")).otherwise(F.col("l_extendedprice").cast("string"))),
        "item": rows("item", "part", i_item_sk=F.col("p_partkey"), i_brand=F.col("p_brand")),
        "date_dim": rows("date_dim", "orders", d_date_sk=F.col("o_orderkey"), d_day_name=F.col("o_orderpriority")),
    }
    with tidy():
        names = {}
        for kind in (*made, "result_table"):
            names[kind], path = scratch_table(spark, kind)
            if kind in made:
                files.write_delimited(made[kind], path)
            schemas.create_table(spark, kind, names[kind], path)
        spark.sql(f"""
            INSERT INTO {names["result_table"]} SELECT count(1) FROM (
              SELECT DISTINCT ss_item_sk, ss_sold_date_sk, ss_sales_price, i_brand, d_day_name FROM {names["store_sales"]} JOIN {names["item"]} ON ss_item_sk = i_item_sk JOIN {names["date_dim"]} ON ss_sold_date_sk = d_date_sk)""")
        return files.read_delimited(spark, path, schemas.TABLES["result_table"])
