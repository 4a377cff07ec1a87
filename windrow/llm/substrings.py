"""Suffix-array dedup of repeated byte strings.

A byte goes if it lies in a window of ``WINDOW`` bytes that also starts in a document with a
smaller id. The windows of all documents are far too many to sort, and only those in places that
occur elsewhere need it:

* Every window is named by the least hash of the ``GRAM``-byte strings in it, so that equal
  windows have equal names, and windows that follow each other mostly share one. Names that occur
  in two documents are found by a packed shuffle of 8 bytes for each run of windows.
* Runs with such a name span bytes (contexts). Contexts with one name are joined and
  suffix-sorted in two stages: suffixes not larger than their successors are sorted
  directly, the others follow by one scan over the buckets of first bytes. Adjacent common
  prefixes of at least a window are groups of equal windows, and the smallest id of a group keeps
  it. Equal contexts are in the text that is sorted once, with all their holders.
* This is done twice: among the contexts of a group of documents, and then, for the contexts that
  another group may have too, in the bucket of the name, where each group sends a context once, for
  its smallest id. No byte goes but by these groups of equal windows.
* The runs that go are returned to their documents.

A phrase that very many groups have, in different surroundings, would bring all of these together.
Names of more than ``HOT_GROUPS`` groups therefore part by a second hash of their windows, which
equal windows share as well.

Documents are dealt to groups of about ``ROWS_PER_GROUP`` by a hash of the row, and what a group has
several times leaves it once: a passage that a third of all documents share costs one context for
each group. Texts are shuffled once, by group; the three passes over them reuse that.

Defined results: null text counts as empty; texts under a window lose nothing; rows that repeat an
id are one document and lose nothing to each other; so are rows with a null id, which comes after
all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import buckets_for, small_batches
from windrow.llm.packed import K1, K2, by_bucket, mixed, pack, packed_schema, short, unpack
from windrow.sources.tables import table

WINDOW, GRAM = 50, 20
#: A group has about so many rows, and bytes, at most.
ROWS_PER_GROUP, BYTES_PER_GROUP = 1500, 16 << 20
#: Groups that share a name, from which on its contexts get second names and part by them.
HOT_GROUPS = 10_000
#: Bytes of contexts that are suffix-sorted at once, as long as one name's fit.
BLOCK = 1 << 19
#: Stands for a null id: above all others.
LAST = 1 << 63
#: Marks the row of a null id.
_NULL = 1 << 30

_U = np.uint64
_END = b"\xff"  # in no UTF-8 text


def runs(b: bytes, window: int = WINDOW, gram: int = GRAM, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the windows of ``b`` as runs: name, first start and end of the starts."""
    n = len(b) - gram + 1
    if len(b) < window:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, _U(seed))
    for j in range(0, gram, 8):  # eight bytes at a time, the last ones overlapping
        h = (h ^ np.ndarray((n,), "<u8", b, min(j, gram - 8), (1,))) * K1
        h ^= h >> _U(29)
    h *= K2
    h ^= h >> _U(32)
    wide, step, m = window - gram + 1, 1, h
    while 2 * step <= wide:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if wide > step:
        m = np.minimum(m[: len(m) - (wide - step)], m[wide - step :])
    at = np.flatnonzero(m[1:] != m[:-1]) + 1
    starts = np.concatenate([[0], at])
    return m[starts], starts, np.concatenate([at, [len(m)]])


def suffix_order(t: bytes, depth: int = WINDOW, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of all suffixes of ``t`` in the order of their first ``depth`` bytes, or more; with
    ``wanted``, of those marked there and of what they are induced from."""
    n, padded = len(t), np.frombuffer(t + _END * (depth + 16), dtype=np.uint8)
    c = padded[:n]
    falls = c > padded[1 : n + 1]  # larger than its successor
    if wanted is not None:
        # A suffix that is larger than its successor is put in place by it: up to the next that isn't.
        ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
        stops = np.minimum.accumulate(np.where(falls, n - 1, np.arange(n))[::-1])[::-1][ends]
        step = np.bincount(ends, minlength=n + 1) - np.bincount(stops, minlength=n + 1)
        wanted = wanted | (np.cumsum(step[:n]) > 0)
        wanted[stops] = True
    direct = np.flatnonzero(~falls if wanted is None else wanted & ~falls)
    word = lambda k, at: np.ndarray((n + 1,), ">u8", padded, 8 * k, (1,))[at].astype(_U)
    words = -(-depth // 8)
    first, second = word(0, direct), word(1, direct)
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    same = np.concatenate([[False], (first[1:] == first[:-1]) & (second[1:] == second[:-1])])
    tied = same | np.append(same[1:], False)
    if tied.any() and words > 2:
        left = direct[order[tied]]
        order[tied] = order[tied][np.lexsort((*(word(k, left) for k in range(words - 1, 1, -1)), np.cumsum(~same)[tied]))]
    direct = direct[order]
    heads = c[direct]
    bounds = np.searchsorted(heads, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for x in range(256):
        bucket = np.concatenate([*induced[x], direct[bounds[x] : bounds[x + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[c[before] > x]  # larger than their successors, which are in place now
        if wanted is not None:
            before = before[wanted[before]]
        to = c[before]
        by = np.argsort(to, kind="stable")
        heads, at = np.unique(to[by], return_index=True)
        for y, some in zip(heads.tolist(), np.split(before[by], at[1:]), strict=False):
            induced[y].append(some)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def same_as_previous(t: bytes, order: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """For each suffix in order, whether it has its first ``depth`` bytes in common with the one before."""
    padded = np.frombuffer(t + _END * (depth + 16), dtype=np.uint8)
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    for at in [*range(0, depth - 7, 8), depth - 8]:
        w = np.ndarray((len(t) + 1,), "<u8", padded, at, (1,))[order]
        same[1:] &= w[1:] == w[:-1]
    return same


def least_holders(contexts: list[bytes], holders: list[int], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of all contexts, one after the other, the least holder of a context with an
    equal one; and where the windows of each context begin."""
    t = _END.join(contexts) + _END
    lengths = np.array([len(x) for x in contexts])
    firsts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    owner = np.repeat(np.arange(len(contexts)), lengths + 1)
    offset = np.arange(len(t)) - firsts[owner]
    starts = offset <= (lengths - window)[owner]
    order = suffix_order(t, window, starts)
    order = order[starts[order]]
    start = np.flatnonzero(~same_as_previous(t, order, window))
    held = np.array(holders)[owner[order]]
    least = np.full(len(t), np.iinfo(np.int64).max)
    if len(order):
        least[order] = np.repeat(np.minimum.reduceat(held, start), np.diff(np.append(start, len(order))))
    return least[starts], np.concatenate([[0], np.cumsum(lengths - window + 1)])


#: Contexts by their names, and by their bytes the occurrences: the document and where it has them.
Names = dict[int, dict[bytes, list[tuple[int, ...]]]]


def gone(names: Names, window: int = WINDOW) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """Occurrences with the stretches of their contexts that a smaller document has as well."""
    block: list[tuple[bytes, list[tuple[int, ...]]]] = []
    held = 0
    for same in [*names.values(), None]:
        if same is not None:
            docs = {at[0] for where in same.values() for at in where}
            if len(docs) > 1:
                block += same.items()
                held += sum(map(len, same))
        if block and (same is None or held >= BLOCK):
            rank = {d: k for k, d in enumerate(sorted({at[0] for _, where in block for at in where}))}
            holders = [min(rank[at[0]] for at in where) for _, where in block]
            least, bounds = least_holders([c for c, _ in block], holders, window)
            lows, highs = (f.reduceat(least, bounds[:-1]).tolist() for f in (np.minimum, np.maximum))
            for (c, where), low, high, k, m in zip(block, lows, highs, bounds.tolist(), bounds[1:].tolist(), strict=False):
                for at in where:
                    if (r := rank[at[0]]) > high:
                        yield at, 0, len(c)
                    elif r > low:
                        for x, y in zip(*(z.tolist() for z in spans(r > least[k:m])), strict=True):
                            yield at, x, y + window - 1
            block, held = [], 0


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _rows(t: pa.Table) -> list[tuple[int, bytes]]:
    """Documents of a group in the order that numbers them."""
    return sorted((LAST if i is None else i, b) for i, b in zip(t.column("id").to_pylist(), t.column("b").to_pylist(), strict=True))


class Repeats:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM, rows_per_group: int = ROWS_PER_GROUP, hot_groups: int = HOT_GROUPS) -> None:
        self.window, self.gram, self.hot_groups = window, gram, hot_groups
        small_batches(docs.sparkSession)
        n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
        self.buckets = buckets_for(docs.sparkSession, 4 * size)
        groups = max(1, n // rows_per_group, size // BYTES_PER_GROUP)
        d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("b"))
        self.docs = d.select(F.pmod(F.xxhash64("id", "b"), F.lit(groups)).alias("g"), "id", "b").repartition(self.buckets, "g")

    def shared(self) -> DataFrame:
        """``g, names, hot``: the names that a group has in common with another, and whether that
        is with very many."""
        window, gram, buckets, hot_groups = self.window, self.gram, self.buckets, self.hot_groups

        def send(t: pa.Table) -> pa.Table:
            names = np.unique(np.concatenate([runs(b, window, gram)[0] for _, b in _rows(t)]))
            return pa.Table.from_batches([pack(buckets, names, short(names), np.full(len(names), t.column("g")[0].as_py(), np.int64), send_keys=False)])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, g = unpack(batches, "<u4", "<i8")
            order = np.argsort(h, kind="stable")
            h, g = h[order], g[order]
            _, counts = np.unique(h, return_counts=True)  # a group sends a name once
            counts = np.repeat(counts, counts)
            h, g, hot = h[counts > 1], g[counts > 1], counts[counts > 1] > hot_groups
            order = np.argsort(g, kind="stable")
            h, g, hot = h[order], g[order], hot[order]
            gs, at = np.unique(g, return_index=True)
            cols = [[x.tobytes() for x in np.split(c, at[1:])] if len(gs) else [] for c in (h, hot)]
            yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], ["g", "names", "hot"])

        sent = self.docs.groupBy("g").applyInArrow(send, packed_schema(2))
        return by_bucket(sent, buckets).mapInArrow(meet, "g long, names binary, hot binary")

    def contexts(self, shared: DataFrame) -> DataFrame:
        """Packed contexts for the buckets of their names (kind 0) and stretches that go for the group alone (kind 1)."""
        window, gram, buckets = self.window, self.gram, self.buckets

        def again(b: bytes, name: int, start: int, end: int) -> Iterable[tuple[int, int, int]]:
            """A context of a hot name in parts by the second names of its windows."""
            both = zip(*(x.tolist() for x in runs(b[start:end], window, gram, 1)), strict=True)
            return [((name ^ h * int(K2)) % (1 << 64), start + s, start + e + window - 1) for h, s, e in both]

        def cut(t: pa.Table, replies: pa.Table) -> pa.Table:
            docs = _rows(t)
            found = [runs(b, window, gram) for _, b in docs]
            halves = [short(h) for h, _, _ in found]
            own = np.sort(np.concatenate([np.zeros(0, np.uint32), *map(np.unique, halves)]))
            told = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in replies.column("names").to_pylist())])
            hot = set(told[np.frombuffer(b"".join(replies.column("hot").to_pylist()), bool)].tolist())
            names = np.unique(np.concatenate([own[1:][own[1:] == own[:-1]], told]))
            told = np.sort(told)
            here: Names = {}
            outside: set[int] = set()
            for r, ((i, b), (h, s, e), half) in enumerate(zip(docs, found, halves, strict=True)):
                if not len(names) or not len(h):
                    continue
                ok = names[np.minimum(np.searchsorted(names, half), len(names) - 1)] == half
                away = told[np.minimum(np.searchsorted(told, half[ok]), len(told) - 1)] == half[ok] if len(told) else np.zeros(int(ok.sum()), bool)
                for name, part, start, end, out in zip(h[ok].tolist(), half[ok].tolist(), s[ok].tolist(), (e[ok] + window - 1).tolist(), away.tolist(), strict=True):
                    for x, a, z in again(b, name, start, end) if part in hot else ((name, start, end),):
                        here.setdefault(x, {}).setdefault(b[a:z], []).append((i, r, a))
                        if out:
                            outside.add(x)
            g = t.column("g")[0].as_py()
            rows = []
            # Wherever the least document has it, which may be several times.
            keep = [(x, *at, c) for x in outside for c, where in here[x].items() for least in (min(where)[0],) for at in where if at[0] == least]
            if keep:
                h, r, s, c = (np.array(x, ty) for x, ty in zip((x for k, x in enumerate(zip(*keep, strict=True)) if k != 1), (_U, np.int32, np.int32, object), strict=True))
                null = np.array([k[1] == LAST for k in keep])
                i = np.array([0 if k[1] == LAST else k[1] for k in keep], np.int64)
                r |= np.where(null, _NULL, 0).astype(np.int32)
                to = (mixed(h) % _U(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                used, at = np.unique(to[order], return_index=True)
                for bucket, some in zip(used.tolist(), np.split(order, at[1:]), strict=True):
                    texts = c[some].tolist()
                    rows.append((bucket, g, 0, short(h[some]).tobytes(), i[some].tobytes(), r[some].tobytes(), s[some].tobytes(), np.array([len(x) for x in texts], np.int32).tobytes(), b"".join(texts)))
            lost = [(at[1], at[2] + x, at[2] + y) for at, x, y in gone(here, window)]
            if lost:
                r, s, e = (np.array(x, np.int32).tobytes() for x in zip(*lost, strict=True))
                rows.append((g % buckets, g, 1, None, None, r, s, e, None))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = (pa.int32(), pa.int64(), pa.int8(), *[pa.binary()] * 6)
            return pa.Table.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True)], ["bucket", "g", "kind", "h", "i", "r", "s", "n", "c"])

        return self.docs.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(cut, "bucket int, g long, kind tinyint, h binary, i binary, r binary, s binary, n binary, c binary")

    def gone(self, contexts: DataFrame) -> DataFrame:
        """``g, r, s, e``: rows of a group and the bytes from s to e that they lose."""
        window = self.window

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, list[tuple[int, int, int]]] = {}
            names: Names = {}
            for batch in batches:
                for _, g, kind, h, i, r, s, n, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    rs, ss, ns = (np.frombuffer(x, np.int32).tolist() for x in (r, s, n))
                    if kind == 1:
                        out.setdefault(g, []).extend(zip(rs, ss, ns, strict=True))
                        continue
                    at = 0
                    for name, doc, row, start, size in zip(np.frombuffer(h, np.uint32).tolist(), np.frombuffer(i, np.int64).tolist(), rs, ss, ns, strict=True):
                        who, row = (LAST, row ^ _NULL) if row & _NULL else (doc, row)
                        names.setdefault(name, {}).setdefault(c[at : at + size], []).append((who, g, row, start))
                        at += size
            for (_, g, row, start), x, y in gone(names, window):
                out.setdefault(g, []).append((row, start + x, start + y))
            cols = [list(out), *([np.array(x, np.int32).tobytes() for x in part] for part in zip(*(zip(*v, strict=True) for v in out.values()), strict=True))] if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), *[pa.binary()] * 3), strict=True)], ["g", "r", "s", "e"])

        return by_bucket(contexts, self.buckets).mapInArrow(meet, "g long, r binary, s binary, e binary")

    def kept(self, with_text: bool = False) -> DataFrame:
        """``id, n_bytes, n_removed, n_spans, kept_sha256``, and ``kept`` (bytes) on request."""

        def cut(t: pa.Table, gone: pa.Table) -> pa.Table:
            docs = _rows(t)
            r, s, e = (np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32) for x in gone.column(k).to_pylist())]) for k in ("r", "s", "e"))
            order = np.argsort(r, kind="stable")
            s, e, bounds = s[order], e[order], np.searchsorted(r[order], np.arange(len(docs) + 1))
            out = []
            for k, (i, b) in enumerate(docs):
                own = slice(bounds[k], bounds[k + 1])
                cover = np.cumsum(np.bincount(s[own], minlength=len(b) + 1) - np.bincount(e[own], minlength=len(b) + 1))[: len(b)] > 0
                left = np.frombuffer(b, np.uint8)[~cover].tobytes() if cover.any() else b
                out.append((None if i == LAST else i, len(b), len(b) - len(left), len(spans(cover)[0]), hashlib.sha256(left).hexdigest(), left if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            return pa.Table.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

        gone = self.gone(self.contexts(self.shared()))
        out = self.docs.groupBy("g").cogroup(gone.groupBy("g")).applyInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
        return out if with_text else out.drop("kept")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, **options: int) -> DataFrame:
    """What is left of each document when repeats of windows are removed."""
    return Repeats(docs, id_col, text_col, **options).kept(with_text)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False).withColumnRenamed("id", "doc_id")


OP2_SQL = r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, b[i:i + 49] AS s FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS i FROM t) x),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.s = m.s WHERE w.doc_id > m.least),
f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM g),
r AS (SELECT doc_id, span, min(i) AS a, max(i) + 49 AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM f) x GROUP BY doc_id, span),
k AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM r
  UNION ALL SELECT t.doc_id, coalesce(max(r.z), 0) + 1, t.n FROM t LEFT JOIN r ON r.doc_id = t.doc_id GROUP BY t.doc_id, t.n),
kept AS (
  SELECT k.doc_id, sha256(unhex(coalesce(string_agg(hex(t.b[k.a:k.z]), '' ORDER BY k.a) FILTER (WHERE k.z >= k.a), ''))) AS kept_sha256
  FROM k JOIN t ON t.doc_id = k.doc_id GROUP BY k.doc_id),
c AS (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, kept.kept_sha256
FROM t JOIN kept ON kept.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id
"""
