"""Operators that SQL can't express, against brute force."""

import hashlib
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from windrow.llm import components, fingerprints, jaccard, packing, substrings

from .conftest import corpus, prose


# -- fingerprints -----------------------------------------------------------------------------


def keys_of(spark, texts):
    """The keys of texts as the operator makes them, each checked to stand for one paragraph."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprints.paragraph_keys(F.col("t")).alias("k"))
    return {r["t"]: set(r["k"]) for r in d.collect()}


def test_paragraphs_are_lines_cut_by_content(spark):
    rng = random.Random(5)
    line = prose(rng, 3000)
    got = keys_of(spark, [line, "before " + line, line[: len(line) // 2], line + "\nend", ""])
    n = len(got[line])
    assert 25 < n < 100 and len(got[""]) == 1
    assert len(got[line] & got["before " + line]) >= n - 1 and len(got[line] - got[line + "\nend"]) == 0
    assert len(got[line] & got[line[: len(line) // 2]]) > 0.3 * n


@pytest.mark.parametrize(("per_range", "bounds", "here"), [(5, 1000, 512), (2, 3, 8), (1000, 1000, 0)])
def test_fingerprints(spark, frame, monkeypatch, per_range, bounds, here):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", per_range)
    monkeypatch.setattr(fingerprints, "MOST_BOUNDS", bounds)
    monkeypatch.setattr(fingerprints, "HERE", here)
    rows = sorted((i + (1 << 60) * (i % 7 == 0), *r) for i, *r in corpus(1)) + [((1 << 63) - 1, "the largest id", "en", None, 0), (None, "last\none", "en", None, 0)]
    rows[5] = (rows[5][0], "\n".join(str(k) for k in range(700)), "en", None, 0)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(frame(rows, extra=True)).collect()}
    assert len(got) == len(rows)
    prints, edits = defaultdict(set), {}
    for k, (i, t, *_) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edits[i] = t, t[: len(t) - half] + after[:half], after
    keys = keys_of(spark, {x for v in edits.values() for x in v})
    for i, (t, edited, after) in edits.items():
        r, a, b, c = got[i], keys[t], keys[edited], keys[after]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and r["near_next"] == pytest.approx(len(a & c) / len(a | c))
        assert sorted(r["lost"]) == sorted(a - b) and sorted(r["gained"]) == sorted(b - a)
        prints[t].add(r["fingerprint"])
        prints[edited].add(r["edited_fingerprint"])
    assert all(len(v) == 1 for v in prints.values())


def test_ids_that_many_rows_repeat_are_cut_by_their_texts(spark, frame, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 10)
    rows = [(i, f"text {k} of {i}", "en", None, 0) for i in (None, 7, 5) for k in range(150)] + [(i, f"other {i}", "en", None, 0) for i in (1, 6, 8, 9)]
    d = frame(rows)
    dealt, _ = fingerprints.with_next(d, "doc_id", "text")
    sizes = sorted(r["count"] for r in dealt.groupBy("range").count().collect())
    assert sizes[-1] < 20
    got = fingerprints.fingerprints(d).collect()
    assert len(got) == len(rows)
    hashes = {r["t"]: r["h"] for r in d.selectExpr("text t", "xxhash64(text) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]]))
    want = {hashlib.sha256((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest() for k, (_, t, *_) in enumerate(order)}
    assert {r["edited_sha256"] for r in got} == want


def test_fingerprints_of_few_rows(spark, frame):
    assert fingerprints.fingerprints(frame([])).count() == 0
    one = fingerprints.fingerprints(frame([(7, "abcd", "en", None, 4)])).first()
    assert (one["edited_sha256"], one["near_next"]) == (hashlib.sha256(b"abab").hexdigest(), 1.0)
    same = fingerprints.fingerprints(frame([(7, "abcd", "en", None, 4)] * 3)).collect()
    assert len(same) == 3 and {r["near_next"] for r in same} == {1.0}


def test_sketches_retry_until_they_peel(spark):
    rng = random.Random(4)
    rows = []
    for n in (0, 1, 20, 300, 3000):
        a = [rng.getrandbits(63) for _ in range(n)]
        rows.append((n, 0, a, a[: n // 2] + [rng.getrandbits(63) for _ in range(n // 3 + 1)]))
    d = spark.createDataFrame(rows, "x long, y long, keys array<long>, others array<long>")
    for tries in (1, 8):
        got = {r["x"]: (set(r["plus"]), set(r["minus"]), len(r["plus"]), len(r["minus"])) for r in fingerprints.recovered(d, tries).collect()}
        assert got == {n: (x := set(a) - set(b), y := set(b) - set(a), len(x), len(y)) for n, _, a, b in rows}


# -- suffix arrays ----------------------------------------------------------------------------


@pytest.mark.parametrize("text", [b"", b"a", b"banana" * 30, b"\x00\x01" * 40 + b"\x00", bytes(range(250)) * 2, b"z" * 300, "één twee é".encode() * 9])
def test_suffix_order(text):
    order = substrings.suffix_order(text).tolist()
    key = lambda p: (text[p:] + b"\xff" * 66)[:50]
    assert sorted(order) == list(range(len(text)))
    assert [key(p) for p in order] == sorted(map(key, range(len(text))))
    rng = np.random.default_rng(len(text))
    for share in (0.02, 0.3, 0.9):
        wanted = rng.random(len(text)) < share
        some = substrings.suffix_order(text, 50, wanted.copy())
        assert len(set(some.tolist())) == len(some) and [key(p) for p in some.tolist() if wanted[p]] == sorted(key(p) for p in np.flatnonzero(wanted).tolist())
    assert substrings.same_as_previous(text, np.array(order, dtype=int)).tolist() == [k > 0 and key(order[k]) == key(order[k - 1]) for k in range(len(order))]


def brute_windows(rows, w=50):
    first, out = {}, {}
    for i, t in sorted((i, (t or "").encode()) for i, t, *_ in rows):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - w + 1):
            if first.setdefault(t[p : p + w], i) < i:
                gone[p : p + w] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[i] = (len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "per_group", "hot"), [(1, 1000, 9), (2, 3, 10_000), (3, 1, 2)])
def test_substrings(spark, frame, monkeypatch, seed, per_group, hot):
    monkeypatch.setattr(substrings, "BLOCK", 2000)
    rng = random.Random(seed)
    rows = corpus(seed, 50)
    passage = prose(rng, 40)
    for k in range(0, 50, 3):  # a passage of many documents, with odd ends
        i, t, *rest = rows[k]
        rows[k] = (i, (t or "")[: rng.randrange(80)] + passage[rng.randrange(20) :] + (t or "")[80:], *rest)
    rows.append((max(r[0] for r in rows) + 1, "ab" * 400, "en", None, 0))
    rows.append((max(r[0] for r in rows) + 1, "b" + "ab" * 200, "en", None, 0))
    for k in (2, 3):  # one document has a passage of others several times
        rows.append((max(r[0] for r in rows) + 1, f"{k} {passage} | {k} {passage} | " * k, "en", None, 0))
    got = {r["id"]: tuple(r)[1:5] for r in substrings.dedup_substrings(frame(rows, extra=True), with_text=False, rows_per_group=per_group, hot_groups=hot).collect()}
    assert got == brute_windows(rows)


def test_nothing_goes_but_by_the_sorted_suffixes(monkeypatch):
    same, other = b"the same bytes in several documents, and more than fifty", b"the same bytes in several documents, and more than sixty of them"
    names = {1: {same: [(7, 0), (3, 0), (9, 0)]}, 2: {same: [(4, 0)], other: [(5, 0), (2, 0)]}, 3: {other: [(8, 0), (8, 5)]}}
    assert sorted(substrings.gone(names)) == [((3, 0), 0, 51), ((4, 0), 0, 56), ((5, 0), 0, 64), ((7, 0), 0, 56), ((9, 0), 0, 56)]
    monkeypatch.setattr(substrings, "suffix_order", lambda *args: np.zeros(0, np.int64))
    assert list(substrings.gone(names)) == []


def test_substrings_of_few_rows(spark, frame):
    assert substrings.dedup_substrings(frame([])).count() == 0
    rows = [(5, "x" * 80, "en", None, 0)] * 2 + [(None, "x" * 60, "en", None, 0), (6, None, "en", None, 0)]
    got = sorted(((r["id"], r["n_removed"], bytes(r["kept"])) for r in substrings.dedup_substrings(frame(rows)).collect()), key=str)
    assert got == [(5, 0, b"x" * 80), (5, 0, b"x" * 80), (6, 0, b""), (None, 60, b"")]
    last = (1 << 63) - 1
    rows = [(i, "y" * 70, "en", None, 0) for i in (None, last, None)] + [(-last - 1, "z" * 50, "en", None, 0), (None, "z" * 50, "en", None, 0)]
    for per_group in (1, 100):
        got = sorted(((r["id"], r["n_removed"]) for r in substrings.dedup_substrings(frame(rows), rows_per_group=per_group).collect()), key=str)
        assert got == [(-last - 1, 0), (last, 0), (None, 50), (None, 70), (None, 70)]


# -- packing ----------------------------------------------------------------------------------


@pytest.mark.parametrize("per_shard", [10, 10_000])
def test_packing(spark, per_shard):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, 300, 900, 4096, 4097, 20_000, rng.randrange(3000)])) for i in range(300)] + [(7, 10), (7, 10), (None, 4), (8, None)]
    d = spark.createDataFrame([(i, n or 0) for i, n in rows], "doc_id long, n_tokens long")
    got = [r.asDict() for r in packing.pack(d, pieces_per_shard=per_shard).collect()]
    assert sorted((r["id"] or -1, r["n_tokens"]) for r in got if r["piece"] == 0 and r["n_tokens"] < 4096) == sorted((i or -1, n or 0) for i, n in [(i if i is not None else -1, n) for i, n in rows] if (n or 0) < 4096)
    assert sum(r["n_tokens"] for r in got) == sum(n or 0 for _, n in rows)
    bins = defaultdict(list)
    for r in got:
        if r["n_tokens"]:
            bins[r["bin"]].append((r["bin_offset"], r["n_tokens"], r["capacity"]))
        else:
            assert (r["bin"], r["capacity"]) == (None, 0)
    for parts in bins.values():
        end = 0
        for at, n, _ in sorted(parts):
            assert at == end
            end += n
        assert {c for *_, c in parts} == {next(c for c in packing.CAPACITIES if c >= end)}
    assert packing.pack(d.limit(0)).count() == 0


def test_shards_hold_pieces_not_rows(spark):
    """40 long texts, and one row in thousands of copies: no shard has much more than its share."""
    from pyspark.sql import functions as F

    long_ = spark.range(40).select("id", F.lit(4096 * 5000).alias("n"))
    same = spark.range(60_000).select(F.lit(None).cast("long").alias("id"), F.lit(3).alias("n"))
    got = packing.pack(long_.unionAll(same).withColumns({c: F.lit(1) for c in ("piece", "row", "shard", "bin", "start")}), "id", "n", pieces_per_shard=10_000)
    shards = got.groupBy((F.col("bin") / (1 << 32)).cast("long")).count().collect()
    assert got.count() == 260_000 and len(shards) == 26 and max(r["count"] for r in shards) < 10_500


def brute_packing(lengths, capacities=packing.CAPACITIES):
    """Best fit done the plain way: bins as lists, all of them tried for each piece."""
    best = None
    for least in (True, False):
        bins, to_come = [], list(lengths)
        for n in lengths:
            to_come.remove(n)
            open_ = [b for b in bins if b[0] - sum(b[1]) >= n]
            if open_:
                min(open_, key=lambda b: b[0] - sum(b[1]))[1].append(n)
                continue
            cost = {}
            for c in capacities:
                if c >= n:
                    room = c - n
                    for x in sorted(to_come, reverse=True):
                        room -= x if x <= room else 0
                    cost[c] = c if least else packing.cost(c) / (c - room)
            bins.append([min(cost, key=lambda c: (cost[c], c)), [n]])
        total = sum(packing.cost(next(c for c in capacities if c >= sum(b[1]))) for b in bins)
        best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_packing_is_best_fit(seed):
    rng = random.Random(seed)
    top = rng.choice([60, 300, 1500, 4096])
    lengths = sorted((rng.randrange(1, top + 1) for _ in range(rng.randrange(1, 120))), reverse=True)
    bins, offsets, sizes = packing.best_fit(lengths)
    assert sum(map(packing.cost, sizes)) == pytest.approx(brute_packing(lengths))
    ends = [0] * len(sizes)
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        assert o == ends[b]
        ends[b] += n
    assert all(c == next(x for x in packing.CAPACITIES if x >= e) for c, e in zip(sizes, ends, strict=True))


@pytest.mark.parametrize(("lengths", "before"), [([260] * 300, 158400.0), ([513] * 100 + [300] * 7, 108800.0)])
def test_packing_opens_longer_bins_where_they_cost_less(lengths, before):
    """``before``: the cost of opening the least length that holds the first piece."""
    bins, offsets, sizes = packing.best_fit(lengths)
    assert sum(map(packing.cost, sizes)) < 0.85 * before
    ends = {}
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        assert o == ends.get(b, 0)
        ends[b] = o + n
    assert all(ends[b] <= sizes[b] for b in ends) and len(ends) == len(sizes)


def test_packing_costs_no_more_than_one_size():
    rng = random.Random(1)
    lengths = sorted((rng.randrange(1, 4097) if rng.random() < 0.3 else rng.randrange(1, 500) for _ in range(3000)), reverse=True)
    total = lambda caps: sum(map(packing.cost, packing.best_fit(lengths, caps)[2]))
    assert total(packing.CAPACITIES) <= total((4096,))
    used = sum(lengths) / sum(packing.best_fit(lengths)[2])
    assert used > 0.97


# -- Jaccard join -----------------------------------------------------------------------------


def brute_groups(rows, n, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("seed", "n", "num", "cells", "different", "most", "many"), [(1, 3, 90, 3, 1, 2048, 64), (2, 5, 80, 4, 2, 3, 1), (3, 3, 90, 3, 1, 2, 2)])
def test_jaccard(spark, frame, seed, n, num, cells, different, most, many):
    rng = random.Random(seed)
    rows = corpus(seed, 80)
    base = prose(rng, 120).split(" ")
    for k in range(40):  # chains of edits around the threshold
        base[rng.randrange(len(base))] = f"new{k}"
        rows.append((1000 + k, " ".join(base), "en", None, 0))
    for k in range(20):  # a group of near copies
        base[5] = f"other{k}"
        rows.append((2000 + k, " ".join(base), "en", None, 0))
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in jaccard.similar_groups(frame(rows, extra=True), n=n, num=num, cells=cells, different=different, most_members=most, many=many).collect()}
    assert got == brute_groups(rows, n, num, 100)


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_with_repeated_ids(spark, frame, seed):
    """An id with several texts is one node: it is linked with all that any of them is."""
    rng = random.Random(seed)
    rows = [(rng.randrange(40), *r) for _, *r in corpus(seed, 60)]
    numbered = [(1000 + k, *r) for k, (_, *r) in enumerate(rows)]
    groups = brute_groups(numbered, 3, 90, 100)
    edges = [(k, groups[k][1]) for k in groups] + [(1000 + k, r[0]) for k, r in enumerate(rows)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = sorted((r[0], groups[1000 + k][0], find(r[0])) for k, r in enumerate(rows))
    assert sorted(map(tuple, jaccard.similar_groups(frame(rows), n=3, num=90).collect())) == want


def test_jaccard_of_few_rows(spark, frame):
    assert jaccard.similar_groups(frame([])).count() == 0
    rows = [(4, "a b c d", "en", None, 0), (2, "A  B c D", "en", None, 0), (4, "a b c d", "en", None, 0), (9, " ", "en", None, 0), (None, "a b c d", "en", None, 0)]
    got = sorted((tuple(r) for r in jaccard.similar_groups(frame(rows), n=3, num=90).collect()), key=str)
    assert got == [(2, 2, 2), (4, 2, 2), (4, 2, 2), (9, 0, 9), (None, 2, None)]
    x, y = "one text of some words", "another text with other words"
    rows = [(5, x), (5, y), (2, y), (9, x), (7, x), (7, " "), (8, None)]
    got = sorted((tuple(r) for r in jaccard.similar_groups(frame([(*r, "en", None, 0) for r in rows]), n=3, num=90).collect()), key=str)
    assert got == [(2, 3, 2), (5, 3, 2), (5, 3, 2), (7, 0, 2), (7, 3, 2), (8, 0, 8), (9, 3, 2)]


def test_large_groups_are_compared_by_blocks(spark):
    """20,000 of one component and ten others: the many meet the few, and no two of the many."""
    from pyspark.sql import functions as F

    join = jaccard.Join(spark.createDataFrame([], "id long, text string"), 3, 90, 100)
    members = spark.range(20_010).select(F.lit(1).alias("name"), "id", F.when(F.col("id") < 20_000, 7).otherwise(F.col("id")).alias("label"), F.lit(20_010).alias("size"))
    got = join.blocks(members)
    tasks = got.groupBy("p", "q").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == 7, 1).otherwise(0)).alias("many")).collect()
    assert sum(r["many"] for r in tasks) == 20_000 and max(r["n"] for r in tasks) < 1.2 * jaccard.MOST_MEMBERS
    assert {(r["p"], r["q"]) for r in tasks} == {(0, 0), *((0, k) for k in range(1, 11))}


@pytest.mark.parametrize(("num", "cells", "different"), [(90, 3, 1), (80, 4, 2), (80, 3, 1)])
def test_similar_sets_share_a_signature_and_pass_the_prefix_filter(num, cells, different):
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 7, 10, 11, 50, 123, 500):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            drop = rng.integers(0, size + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**64, rng.integers(0, size // 8 + 2), dtype=np.uint64)]))
            if len(b) and jaccard.similar(a, b, num, 100):
                assert set(jaccard.signatures(a, num, 100, cells, different).tolist()) & set(jaccard.signatures(b, num, 100, cells, different).tolist())
                x, y = (s[: jaccard.prefix(len(s), num, 100)[0]] for s in (a, b))
                assert len(np.intersect1d(x, y)) >= max(jaccard.prefix(len(s), num, 100)[1] for s in (a, b))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == min(seen)
    assert set(got) == set(near)
