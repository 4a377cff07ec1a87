"""The classifier's held-out accuracy, and the pipeline stage by stage."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF

from windrow.llm import quality
from windrow.llm.queries import QUERIES

from .conftest import corpus
from .test_brute import brute_groups

SF_LARGER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_LARGER}/labels.parquet").collect()}
    rows = QUERIES["op9_quality"](spark, SF_LARGER).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    tested = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(tested) > 80 and np.mean([p == y for p, y in tested]) > 0.95


def test_fit_finds_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert (0, 2) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.93
    order = rng.permutation(len(x))
    assert np.allclose(quality.fit(x[order], y[order]).score(x), m.score(x))


def test_scoring_is_a_sum_of_table_entries():
    rng = np.random.default_rng(2)
    x, y = rng.random((300, 3)), rng.integers(0, 2, 300).astype(float)
    m = quality.fit(x, y)
    for row, s in zip(x[:20], m.score(x[:20]), strict=True):
        z = m.base + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(m.tables, m.edges, row, strict=True))
        z += sum(t[np.searchsorted(m.pair_edges[a], row[a], side="right"), np.searchsorted(m.pair_edges[b], row[b], side="right")] for (a, b), t in zip(m.pairs, m.pair_tables, strict=True))
        assert s == pytest.approx(1 / (1 + np.exp(-z)))


def test_odd_rows_and_few_labels(spark, frame):
    d = frame([*corpus(1, 10), (None, "x", "en", None, 1)], extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.scored(d, quality.train(d, none)).collect()} == {0.5}
    ids = [r["doc_id"] for r in d.collect() if r["doc_id"] is not None]
    odd = spark.createDataFrame([(ids[0], 1), (ids[0], 1), (ids[1], None), (None, 0), (ids[2], 0), (ids[3], 0), (ids[4], 1)], "doc_id long, quality int")
    assert quality.scored(d, quality.train(d, odd)).count() == d.count()
    assert quality.scored(d.limit(0), quality.train(d.limit(0), odd)).count() == 0


def test_no_more_rows_than_the_bound_reach_the_driver(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x.shape, sorted(y))))
    d = spark.range(5000).selectExpr("cast(1 as long) doc_id", "concat('text ', id % 50) text").unionAll(spark.createDataFrame([(2, "a"), (3, "b")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    quality.train(d, labels, most_rows=40)
    quality.train(d, labels, most_rows=40)
    assert seen[0] == seen[1] and seen[0][0] == (40, len(quality.FEATURES))


def test_labels_and_ids_are_no_inputs(spark, frame):
    a = frame([(1, "some text", "en", "a", 9), (2, "some text", "de", None, 0)])
    m = quality.fit(np.random.default_rng(0).random((50, len(quality.FEATURES))), np.arange(50) % 2.0)
    x, y = (r["score"] for r in quality.scored(a, m).collect())
    assert x == y


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [d.collect() for d in seen]
    assert all(d.dtypes == docs.dtypes for d in seen[:-1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in rows[1]}
    good = [i in kept for i, q in labels.items() if q == 1]
    assert np.mean(good) > 0.97 and {r["doc_id"] for r in rows[0]} >= kept
    # lines
    first, want = {}, {}
    for r in sorted(rows[1], key=lambda r: r["doc_id"]):
        out = []
        for line in r["text"].split("\n"):
            key = line.encode().strip(b" \t\n\v\f\r").lower().decode()
            if len(key) < 10 or first.setdefault(key, r["doc_id"]) == r["doc_id"]:
                out.append(line)
        want[r["doc_id"]] = "\n".join(out)
    assert {r["doc_id"]: r["text"] for r in rows[2]} == want and all(r["n_chars"] == len(r["text"]) for r in rows[2])
    # near duplicates
    groups = brute_groups([tuple(r) for r in rows[2]], 5, 80, 100)
    assert {r["doc_id"] for r in rows[3]} == {i for i, (_, c) in groups.items() if i == c}
    # mixing
    size = lambda rs: sum(len(r["text"].encode().split()) for r in rs)
    assert abs(size(rows[4]) - size(rows[3])) <= len({r["source"] for r in rows[3]})
    assert {r["doc_id"] for r in rows[4]} <= {r["doc_id"] for r in rows[3]}
    # packing
    assert sum(r["n_tokens"] for r in rows[5]) == size(rows[4])
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, rows[5]))


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_pipeline_over_odd_tables(spark, frame, tmp_path, kind):
    """Nulls, empty and repeated rows, ids of several texts, and columns whose names clash."""
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"), "doc_id").limit(12).collect()]
    rows = [] if kind == "empty" else [*corpus(4, 15), *((900 + k, t, None, "a", None) for k, t in enumerate(good)), (900, good[1], "en", "b", 1), (None, good[2], "en", None, 1), (None, None, None, None, None), (901, good[1], "en", "a", 1)]
    frame(rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(900 + k, 1) for k in range(6)] + [(r[0], 0) for r in corpus(4, 15)[:6]], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs if not seen else seen[-1], str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        seen.append(spark.read.parquet(str(tmp_path / f"s{k}")))
    assert all(d.dtypes == docs.dtypes for d in seen[:-1])
    packed = seen[-1].collect()
    assert sum(r["n_tokens"] for r in packed) == sum(len(r["text"].encode().split()) for r in seen[-2].collect())
    assert (len(packed) > 0) == (kind == "odd") and all(r["n_tokens"] > 0 for r in packed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
