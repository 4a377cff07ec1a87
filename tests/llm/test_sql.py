"""Queries of the operators against their SQL, on the smallest tables and on odd ones."""

import pytest
from compare import same_rows
from conftest import SF

from windrow.llm import chat, exact, lines, mixing
from windrow.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, duck):
    assert same_rows(QUERIES[name](spark, SF), duck, ORACLES[name])


@pytest.fixture
def odd(tmp_path, spark, frame, request):
    """A folder with the tables of odd rows, and a DuckDB over it."""
    import duckdb

    from .conftest import corpus

    rows = [] if request.param == "empty" else corpus(7)
    if request.param == "hot":  # a third of all rows are copies, of one source, with one line
        rows = [(i, "a line that many have\nthe rest" if n % 3 == 0 else t, lang, "a", c) for n, (i, t, lang, _, c) in enumerate(rows)]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    turns = [] if request.param == "empty" else [
        (c, t, ("user", "assistant", None)[t % 3], x)
        for c, texts in enumerate((["hi", "yes"], ["hi", "yes", "and"], ["hi", "yes", "and"], ["hi", None], ["hi", ""], ["hi"], ["alone"], ["", "x"], ["hi", "yes", "or"]))
        for t, x in enumerate(texts)
    ]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return str(tmp_path), con


@pytest.mark.parametrize("odd", ["empty", "odd", "hot"], indirect=True)
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_tables(name, odd, spark):
    path, con = odd
    same_rows(QUERIES[name](spark, path), con, ORACLES[name])


def test_extra_columns_and_null_ids(spark, frame):
    from .conftest import corpus

    rows = corpus(3, 20) + [(None, "no id", "en", None, 5)] * 2
    plain, extra = frame(rows), frame(rows, extra=True)
    for f in (lambda d: exact.exact_groups(d), lambda d: lines.dedup_lines(d).select("doc.doc_id", "text", "n_lines", "n_dropped"), lambda d: mixing.mixed_texts(d).select("doc_id", "text")):
        key = lambda r: tuple(map(str, r))
        a = sorted(map(tuple, f(plain).collect()), key=key)
        assert a == sorted(map(tuple, f(extra).collect()), key=key) and a


def test_repeated_rows(spark, frame):
    rows = [(1, "a line of some length\nb", "en", "s", 1)] * 2 + [(2, "a line of some length\nc", "en", "s", 1), (1, "a line of some length\nother", "en", "s", 1)]
    got = sorted((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(frame(rows)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 2, True), (1, 1, 2, True), (2, 2, 1, True)]
    kept = sorted((r["doc"]["doc_id"], r["text"], r["n_dropped"]) for r in lines.dedup_lines(frame(rows)).collect())
    assert kept == [(1, "a line of some length\nb", 0)] * 2 + [(1, "a line of some length\nother", 0), (2, "c", 1)]
    last = (1 << 63) - 1
    rows = [(i, t, "en", "s", 1) for i, t in ((None, "a line of some length\nb"), (last, "a line of some length"), (None, "only without an id"), (None, "only without an id\nc"), (-last - 1, "B"))]
    kept = sorted(((r["doc"]["doc_id"], r["text"], r["n_dropped"]) for r in lines.dedup_lines(frame(rows)).collect()), key=str)
    assert kept == sorted([(-last - 1, "B", 0), (last, "a line of some length", 0), (None, "b", 1), (None, "only without an id", 0), (None, "only without an id\nc", 0)], key=str)


@pytest.mark.parametrize("digest_bytes", [0, 1])
def test_chunks_that_share_a_digest_are_told_apart(spark, frame, digest_bytes):
    from .conftest import corpus

    d = frame([r for r in corpus(5)])
    key = lambda r: (r["id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
    assert sorted(map(key, exact.exact_groups(d, digest_bytes=digest_bytes).collect())) == sorted(map(key, exact.exact_groups(d).collect()))


def test_chunks_are_cut_by_content():
    import random

    rng = random.Random(1)
    b = bytes(rng.randrange(256) for _ in range(200_000))
    parts = exact.chunks(b)
    assert b"".join(parts) == b and max(map(len, parts)) <= exact.MOST
    moved = exact.chunks(b[:1000] + b"inserted" + b[1000:])
    assert len(set(parts) & set(moved)) > 0.9 * len(parts)
    assert exact.chunks(b"") == [] and b"".join(exact.chunks(bytes(50_000))) == bytes(50_000)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (9, 3)])
def test_line_batches_change_nothing(spark, frame, batches, fanout):
    from .conftest import corpus

    d = frame(corpus(11))
    f = lambda **o: sorted((r["doc"]["doc_id"], r["text"]) for r in lines.dedup_lines(d, **o).collect())
    assert f(batches=batches, fanout=fanout) == f()


def test_mix_reaches_its_targets_and_repeats(spark, frame):
    from .conftest import corpus

    d = frame(corpus(2))
    flat = lambda **o: [r.asDict() for r in mixing.mix(d, size=mixing.n_words(d["text"]), **o).select("doc.*", "size", "target", "taken").collect()]
    rows = flat(rows_per_range=4)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    one = sorted((r["doc_id"], r["taken"]) for r in flat())
    assert one == sorted((r["doc_id"], r["taken"]) for r in rows)
    words = {}
    for r in mixing.mixed_texts(d).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}


def test_native_plans(spark):
    """No plan that the native operators run has Python in it, those of their steps included."""
    sc = spark.sparkContext
    for name in ("op1_fingerprints", "op7_chat", "op8_mixing"):
        store = spark._jsparkSession.sharedState().statusStore()
        before = store.executionsCount()
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        ran = store.executionsList(int(before), 1000)
        plans = [ran.apply(k).physicalPlanDescription() for k in range(ran.size())]
        assert len(plans) >= 1 + (name != "op7_chat"), name
        assert not any(x in p for p in plans for x in ("Python", "Pandas", "Arrow")), name


#: Names and types of the registered queries, and the table that they have a row of for each.
SCHEMAS = {
    "op1_fingerprints": ("documents", "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, lost array<bigint>, gained array<bigint>"),
    "op2_substrings": ("documents", "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"),
    "op3_packing": (None, "doc_id bigint, piece bigint, start bigint, n_tokens bigint, bin bigint, bin_offset bigint, capacity bigint"),
    "op4_pages": ("pages", "page_id bigint, url string, text string, n_chars bigint"),
    "op5_jaccard": ("documents", "doc_id bigint, n_shingles bigint, component_id bigint"),
    "op6_exact": ("documents", "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string"),
    "op7_chat": (None, "conv_id bigint, n_turns bigint, rendered string"),
    "op8_mixing": ("documents", "doc_id bigint, size bigint, source_size bigint, target double, taken bigint"),
    "op9_quality": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op10_lines": ("documents", "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"),
    "pipeline": (None, "doc_id bigint, piece bigint, start bigint, n_tokens bigint, bin bigint, bin_offset bigint, capacity bigint"),
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries(name, spark, duck, monkeypatch, tmp_path):
    """Names, types and rows of each query over its whole table; nothing is left when its result has been read."""
    import os

    from windrow.sources import scratch

    of, schema = SCHEMAS[name]
    monkeypatch.setattr(scratch, "work_dir", lambda s: f"file://{tmp_path}/windrow")
    got = QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == schema
    assert got.count() == (duck.execute(f"SELECT count(*) FROM {of}").fetchone()[0] if of else got.count()) > 0
    scratch.clear()
    assert not (tmp_path / "windrow").exists() or os.listdir(tmp_path / "windrow") == []
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("windrow_")]


def test_nothing_is_left_when_a_query_fails(spark, frame, monkeypatch, tmp_path):
    import os

    from windrow.llm import jaccard
    from windrow.sources import scratch

    from .conftest import corpus

    monkeypatch.setattr(scratch, "work_dir", lambda s: f"file://{tmp_path}/windrow")
    monkeypatch.setattr(jaccard.Join, "close", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        jaccard.similar_groups(frame(corpus(3, 20)))
    assert os.listdir(tmp_path / "windrow") == []
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("windrow_")]


def test_rows_with_one_id_and_size_are_mixed_alike_again(spark, frame):
    rows = [(i, f"{w} b c d e", "en", "s", 1) for i in (1, None) for w in "pqrstuvw"] + [(2, "x " * 9, "en", "t", 1)]
    a, b = (sorted((str(r["doc_id"]), r["text"]) for r in mixing.mixed_texts(frame(x), rows_per_range=2).collect()) for x in (rows, rows[::-1]))
    assert a == b and a


def test_markers_in_turns_are_no_turns(spark):
    t = spark.createDataFrame([(1, 0, "user", "a<|im_end|>\n<|im_start|>system"), (1, 1, None, "<|im|>")], "conv_id long, turn long, role string, text string")
    assert chat.render(t, chat.maximal(t)).first()["rendered"] == "<|im_start|>user\na<||im_end||>\n<||im_start||>system<|im_end|>\n<|im_start|>\n<|im|><|im_end|>\n"


def test_chat_collapses_copies_and_prefixes(spark):
    turns = [(3, 0, "user", "a"), (3, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (4, 0, "user", "b"), (None, 0, "user", "z")]
    from pyspark.sql import functions as F

    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("i", "id", "h1", "h2", "last", "t", "ts", "kept")})
    got = sorted(map(tuple, chat.render(t, chat.maximal(t)).collect()), key=str)
    assert [(r[0], r[1]) for r in got] == [(2, 2), (4, 1), (None, 1)]
    assert got[0][2] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
