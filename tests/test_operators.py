"""Goldens, brute-force models and plans."""

import random
import zlib
from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F

from windrow.functions import config
from windrow.functions.options import spark_settings
from windrow.operators import exchange, flow, layout, metrics, placement, reconcile
from windrow.operators.ranking import numbered
from windrow.plans import layout as layout_plans
from windrow.plans.flow import mod_chain_checksum
from windrow.sources import files
from windrow.sources.tables import table
from windrow.streaming.words import line_stream, word_counts


def plan(df):
    return df._jdf.queryExecution().toString()


def test_mod_chain_golden(spark):
    assert tuple(mod_chain_checksum(spark, SF).first()) == (50418, 3_000_000)


def test_mod_chain_keeps_its_exchanges(spark):
    pairs = files.sequence(spark, 1, 10).select(F.col("id").alias("f0"), (F.col("id") + 1).alias("f1"))
    assert plan(flow.mod_chain(pairs, 4)).count("REPARTITION_BY_NUM") >= 2


@pytest.mark.parametrize("move", [lambda d: exchange.by_hash(d, 3, "l_orderkey"), lambda d: exchange.rebalance(d, 5), lambda d: exchange.rescale(d, 2), lambda d: exchange.rescale(d, 6, grow=True)])
def test_moving_rows_changes_nothing(spark, move):
    d = table(spark, SF, "lineitem")
    h = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*d.columns))).first())
    assert h(move(d)) == h(d)


def test_route_puts_rows_where_they_say(spark):
    d = exchange.route(spark.range(100).withColumn("to", (F.col("id") % 5).cast("int")), 5, "to")
    assert d.filter(F.spark_partition_id() != F.col("to")).count() == 0


def test_broadcast_copies(spark):
    assert exchange.to_all(spark.range(3), 4).count() == 12


def test_scan_is_pruned(spark):
    p = plan(table(spark, SF, "lineitem").filter("l_linenumber = 1").groupBy("l_returnflag").count())
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,1)]" in p
    assert "ReadSchema: struct<l_linenumber:int,l_returnflag:string>" in p
    assert "partial_count" in p


def test_word_count_stays_in_the_jvm(spark):
    assert "Python" not in plan(flow.words(table(spark, SF, "documents")).groupBy("word").count())


def test_delimited_file_with_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1|x|2.5\n2|y|oops\nz|w|\n")
    rows = files.read_delimited(spark, str(tmp_path / "a.csv"), "a long, b string, c double").collect()
    assert [tuple(r) for r in rows] == [(1, "x", 2.5), (2, "y", None), (None, "w", None)]


def test_text_sink_overwrites_and_inputs_repeat(spark, tmp_path):
    d = files.collection(spark, [("a", 1), ("b", 2)], "w string, n int")
    for _ in range(2):
        files.write_text(d, str(tmp_path / "out"))
    assert sorted(r[0] for r in files.read_text(spark, str(tmp_path / "out"), str(tmp_path / "out")).collect()) == ["(a,1)", "(a,1)", "(b,2)", "(b,2)"]


def test_discard_and_observe(spark):
    d, seen = flow.observed_count(files.sequence(spark, 0, 20))
    files.discard(d)
    assert seen.get["n"] == 21


def test_byte_records_repeat(spark):
    a, b = (sorted(bytes(r["record"]) for r in files.byte_records(spark, 1, 10, 5, 100).collect()) for _ in range(2))
    assert a == b and len(set(a)) == 5 and {len(x) for x in a} == {100}


def test_numbered(spark):
    rng = random.Random(1)
    keys = [rng.randrange(1000) * 7 for _ in range(500)] + [10**6]
    d = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k long, n long")
    got = {r["n"]: r["at"] for r in numbered(d, "k", "at", "n", rows_per_range=20).collect()}
    assert got == {n: at for at, (_, n) in enumerate(sorted((k, n) for n, k in enumerate(keys)), 1)}
    assert numbered(d.limit(0), "k", "at").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_greedy_groups(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), n, rng.random() < 0.2, rng.choice([1, 30, 90, 200])) for n in range(200)]
    d = spark.createDataFrame(rows, "p string, seq long, all boolean, bytes long")
    got = {r["seq"]: r["region"] for r in layout.greedy_groups(d, ["p"], ["seq"], "bytes", 150, "all", 16, "region").collect()}
    for p in "ab":
        region, used, mode = 0, 0, None
        for q, seq, m, n in rows:
            if q == p:
                if used and (m != mode or used + n + 16 > 150):
                    region, used = region + 1, 0
                used, mode = used + n + 16, m
                assert got[seq] == region


def test_index_of_a_sound_file_has_no_violations(spark):
    index = layout.region_index(layout_plans.regions(spark, SF), 4).withColumn("magic", F.lit(layout.MAGIC))
    files = layout_plans.records(spark, SF).groupBy("producer").agg(F.sum("bytes").alias("file_bytes"))
    v = layout.violations(index, files).agg(*[F.sum(c) for c in ("negative", "before", "beyond", "magic", "gap")]).first()
    assert tuple(v) == (0, 0, 0, 0, 0)


def test_trailers(spark):
    import struct

    index = layout.region_index(layout_plans.regions(spark, SF), 4)
    rows = {r["producer"]: r for r in layout.trailer(index).collect()}
    for p, r in rows.items():
        own = index.filter(F.col("producer") == p).orderBy("region", "sub").collect()
        b = b"".join(struct.pack(">qqi", x["offset"], x["bytes"], layout.MAGIC) for x in own)
        assert (r["n_regions"], r["index_bytes"], r["crc"]) == (len(own) // 4, len(b), zlib.crc32(b))
    lost = layout.committed(index.filter("producer <> 'en'"), layout.trailer(index))
    assert dict(lost.collect()) == {p: "missing" if p == "en" else "ok" for p in rows}


def test_crc32(spark):
    for r in layout.with_header(spark.createDataFrame([("",), ("abc",), ("é",)], "t string"), F.col("t").cast("binary"), F.col("t") != "abc").collect():
        assert (r["bytes"], r["crc"]) == (len(r["t"].encode()), 0 if r["t"] == "abc" else zlib.crc32(r["t"].encode()))


def workers(spark, rows):
    return spark.createDataFrame(rows, "worker long, host long, hdd_free long, ssd_free long, hdd_used long, ssd_used long, n_partitions long")


def test_two_workers_take_turns(spark):
    w = workers(spark, [(n, n, 1 << 40, 0, 0, 0, 0) for n in (1, 2)])
    got = placement.round_robin(spark.range(100).withColumnRenamed("id", "request"), w).orderBy("request").collect()
    assert [r["worker"] for r in got] == [1, 2] * 50


def test_space(spark):
    w = workers(spark, [(1, 1, 1025, 0, 1023, 1023, 0), (2, 1, 0, 0, 1025, 1025, 0), (3, 1, None, None, None, None, 0), (4, 1, 1024, 0, 0, 0, 0)])
    assert [r["worker"] for r in placement.valid(w, 1024, 1024).collect()] == [1]


@pytest.mark.parametrize("seed", range(4))
def test_min_num(spark, seed):
    rng = random.Random(seed)
    have = {n: rng.randrange(12) for n in range(rng.randrange(1, 7))}
    n = rng.randrange(1, 60)
    got = placement.min_num(spark.range(n).withColumnRenamed("id", "request"), workers(spark, [(k, k, 0, 0, 0, 0, v) for k, v in have.items()])).orderBy("request").collect()
    want = []
    for _ in range(n):
        k = min(have, key=lambda k: (have[k], k))
        have[k] += 1
        want.append(k)
    assert [r["worker"] for r in got] == want


def test_min_num_makes_no_more_places_than_it_needs(spark):
    """One worker has very many partitions already; the others share the requests."""
    w = workers(spark, [(k, k, 0, 0, 0, 0, 1_000_000 if k == 0 else k % 3) for k in range(200)])
    got = placement.min_num(spark.range(2000).withColumnRenamed("id", "request"), w)
    counts = {r["worker"]: r["count"] for r in got.groupBy("worker").count().collect()}
    assert got.count() == 2000 and 0 not in counts and max(counts.values()) - min(counts.values()) <= 3


def test_numbering_ranges_hold_alike_many_rows(spark):
    from windrow.operators.ranking import quantiles, range_of

    d = spark.range(20_000).unionAll(spark.createDataFrame([(1 << 60,)], "id long"))
    bounds, parts = quantiles(d, "id", 20)
    sizes = [r["count"] for r in d.groupBy(range_of(F.col("id"), bounds, parts)).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1300
    assert numbered(d, "id", "at", rows_per_range=1000).filter("at <> least(id, 20000) + 1").count() == 0


def test_disks_take_turns(spark):
    """Ten thousand requests are spread over the disks with room, evenly."""
    d = spark.createDataFrame([(1, k, "SSD" if k < 4 else "HDD", 500 if k != 2 else 5, 0, k != 3) for k in range(8)], "worker long, disk long, medium string, free long, used long, healthy boolean")
    q = spark.range(1200).select(F.col("id").alias("request"), F.lit(1).cast("long").alias("worker"))
    share = lambda **o: {r["disk"]: r["count"] for r in placement.spread_over_disks(q, d, reserve=100, limit=100, **o).groupBy("disk").count().collect()}
    assert share(preferred="SSD") == {0: 600, 1: 600} and share(preferred="HDD") == {k: 300 for k in range(4, 8)}
    assert share(preferred="HDD", only="SSD") == {0: 600, 1: 600}


def test_locality_and_strategies(spark):
    w = workers(spark, [(1, 7, 0, 0, 0, 0, 0), (2, 7, 0, 0, 0, 0, 0), (3, 8, 0, 0, 0, 0, 0)])
    q = spark.createDataFrame([(0, 7), (1, 9), (2, 8), (3, 9), (4, None)], "request long, host long")
    assert dict(placement.strategy("LOCALITY")(q, w).collect()) == {0: 2, 1: 1, 2: 3, 3: 2, 4: 3}
    with pytest.raises(ValueError):
        placement.strategy("nearest")


def test_disks(spark):
    d = spark.createDataFrame(
        [(1, 1, "SSD", 10, 0, True), (1, 2, "HDD", 500, 0, True), (2, 1, "SSD", 90, 0, False), (2, 2, "HDD", 5, 0, True), (3, 1, "SSD", 5, 0, True), (3, 2, "SSD", 9, 0, True), (4, 1, "SSD", 500, 0, True), (4, 2, "HDD", 600, 0, True)],
        "worker long, disk long, medium string, free long, used long, healthy boolean",
    )
    assert {r["worker"]: (r["medium"], r["disk"]) for r in placement.choose_disk(d, "SSD", 100, 100).collect()} == {1: ("HDD", 2), 2: ("HDD", 2), 3: ("SSD", 2), 4: ("SSD", 1)}


def test_reconcile_has_seven_outcomes(spark):
    known = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, True), (1, 4, False), (1, 5, False)], "worker long, partition long, releasing boolean")
    reports = spark.createDataFrame([(1, 2, True), (1, 3, False), (1, 4, True), (1, 5, False), (1, 6, False), (1, 7, True)], "worker long, partition long, releasing boolean")
    got = {r["partition"]: r["action"] for r in reconcile.reconcile(known, reports).collect()}
    assert got == {1: "forget", 2: "drop_meta", 3: "release_data", 4: "mark_and_drop_meta", 5: "none", 6: "add", 7: "add_and_drop_meta"}


def test_metric_groups(spark):
    m = spark.createDataFrame([("jvm", 1.0), ("exchange.a", 2.0)], "grp string, value double")
    n = lambda *g: metrics.select_groups(m, g).count()
    assert (n(), n("jvm"), n("exchange"), n("x"), n("x", "jvm")) == (2, 1, 1, 0, 1)
    assert metrics.select_groups(m.filter("grp = 'jvm'"), ["exchange"]).count() == 1


@pytest.mark.parametrize(
    ("text", "size", "nanos"),
    [("10", 10, 10_000_000), (" 3 kb ", 3072, None), ("2M", 2 << 20, None), ("1 g", 1 << 30, None), ("5min", None, 300 * 10**9), ("321 s", None, 321 * 10**9), ("", None, None), ("b", None, None), ("7 x", None, None), ("99999999999999999999", None, None), ("9000000000 t", None, None), ("-1", None, None)],
)
def test_amounts(spark, text, size, nanos):
    d = spark.createDataFrame([(text,)], "s string")
    assert tuple(d.select(config.memory_bytes(F.col("s")), config.duration_nanos(F.col("s"))).first()) == (size, nanos)


@pytest.mark.parametrize(("text", "want"), [("A;B;C", ["A", "B", "C"]), ("'A;B';C", ["A;B", "C"]), ("\"AB'D\";B;C", ["AB'D", "B", "C"]), ("'it''s';\"a\"\"b\"", ["it's", 'a"b']), ("A;;B", ["A", "", "B"]), ("'';B", ["", "B"]), ("'a'x;B", None), ("'open;B", None), ("a'b;c", ["a'b", "c"]), (";A;", ["A"]), ("", [])])
def test_quoted_lists(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(config.split_quoted(F.col("s"))).first()[0] == want


def test_quoting_is_inverse(spark):
    items = ["a", "b;c", "d'e", 'f"g']
    d = spark.createDataFrame([tuple(items)], "a string, b string, c string, d string")
    line = F.concat_ws(";", *[config.quoted(F.col(c)) for c in "abcd"])
    assert d.select(config.split_quoted(line)).first()[0] == items


def test_data_dirs_and_sizes(spark):
    d = spark.createDataFrame([("[SSD]/a,[HDD]/b/, /c,", 5 << 20)], "s string, n long").select(config.data_dirs(F.col("s")), config.human_bytes(F.col("n"))).first()
    assert [tuple(x) for x in d[0]] == [("SSD", "/a/"), ("HDD", "/b/"), ("HDD", "/c/")] and d[1] == "5.00 mb"


def test_word_count_over_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("to be or not\nto be\n")
    q = word_counts(line_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("words_seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert dict(spark.table("words_seen").collect()) == Counter("to be or not to be".split())


def test_options_become_settings():
    got = spark_settings({"job.enable-data-compression": True, "storage.local-data-dirs": "[SSD]/a, /b,", "rpc.timeout": "30s"})
    assert got == {"spark.shuffle.compress": "true", "spark.local.dir": "/a,/b", "spark.rpc.askTimeout": "30s"}
    with pytest.raises(KeyError):
        spark_settings({"no.such": 1})


def test_small_reducers_are_read_together(spark):
    d = spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count()
    d.collect()
    assert "AQEShuffleRead coalesced" in d._jdf.queryExecution().executedPlan().toString()


def test_session_factory_has_the_defaults(spark):
    from windrow.session import DEFAULTS, session

    s = session(app="again", spark__sql__shuffle__partitions="4")
    assert all(s.conf.get(k) == v for k, v in DEFAULTS.items() if k.startswith("spark.sql"))


def test_what_queries_write_is_removed(spark, monkeypatch, tmp_path):
    import os

    from windrow import registry
    from windrow.sources import scratch

    monkeypatch.setattr(scratch, "work_dir", lambda s: f"file://{tmp_path}/windrow")
    left = lambda: os.listdir(tmp_path / "windrow") if (tmp_path / "windrow").exists() else []
    scratch.clear()
    assert registry.queries()["insert_select"](spark, SF).count() == 2 and len(left()) == 1
    scratch.clear()
    assert left() == []
    with pytest.raises(KeyError), scratch.tidy():
        spark.range(3).write.parquet(scratch.scratch(spark, "x"))
        assert len(left()) == 1
        raise KeyError
    assert left() == []
    assert scratch.shared("hdfs://x/y/", "yarn") == "hdfs://x/y" and scratch.shared(None, "local[4]").startswith("file:")
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        scratch.shared(None, "local-cluster[2,1,1024]")


def test_catalogue(spark):
    sizes = {g: len(names.split()) for g, names in metrics.CATALOGUE.items()}
    assert sizes == {"cluster": 8, "storage": 22, "network": 6}
    got = {r["metric"]: r["value"] for r in metrics.catalogued(spark.createDataFrame([(3, 5)], "num_data_partitions long, other int"), "storage").collect()}
    assert len(got) == 22 and got["exchange.storage.num_data_partitions"] == 3.0


def test_blocking_edges(spark):
    """A shuffle is written in full before its readers begin: they are a stage of their own."""
    spark.sparkContext.setJobGroup("blocking", "")
    spark.range(100).repartition(3).filter("id > 1").groupBy((F.col("id") % 3).alias("k")).count().collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("blocking")
    stages = {s for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) >= 3


def test_framed_bytes_come_apart(spark):
    pieces = [b"", b"abc", bytes(300)]
    framed = b"".join(len(x).to_bytes(4, "big") + x for x in pieces)
    d = spark.createDataFrame([(framed,), (framed[:-1],), (b"",)], "b binary").select(config.split_framed(F.col("b")))
    assert [r[0] and [bytes(x) for x in r[0]] for r in d.collect()] == [pieces, None, []]


def test_scopes_within_scopes(spark, monkeypatch, tmp_path):
    """What an outer scope keeps is still known to ``clear`` when inner ones, empty or not, have ended."""
    import os

    from windrow.sources import scratch

    monkeypatch.setattr(scratch, "work_dir", lambda s: f"file://{tmp_path}/windrow")
    scratch.clear()
    with scratch.tidy():
        kept = scratch.scratch(spark, "kept")
        spark.range(1).write.parquet(kept)
        with scratch.tidy():
            pass
        with scratch.tidy(keep=False):
            spark.range(1).write.parquet(scratch.scratch(spark, "gone"))
    assert [kept.rsplit("/", 1)[1]] == os.listdir(tmp_path / "windrow")
    scratch.clear()
    assert os.listdir(tmp_path / "windrow") == []
