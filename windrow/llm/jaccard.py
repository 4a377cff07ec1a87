"""N-gram Jaccard join with PartEnum signatures.

Documents are sets of hashed word shingles. Equal sets are one class and only its smallest id goes
on. Sets are compared within bands of sizes: two similar sets are in the same band or in
neighbouring ones, and every set takes part in its own band and the next. Within a band,
similarity bounds the number ``k`` of shingles that are in one set only. The domain of hashes is
cut into ``n1`` parts, so that one part has at most ``k2`` of those, and each part into ``n2``
cells; whichever cells differ, ``n2 - k2`` others of that part are equal in both sets. Each choice
of ``n2 - k2`` cells gives a signature of their contents, and similar sets share one.

Before that, sets without a chance are left out: the smallest hashes of a set must hold enough
shingles that some other set has among its own smallest (a prefix filter; exact).

Groups of equal signatures are not expanded into pairs. First, members are compared with the
smallest id of their group, over a part of the signatures, and components are formed; this joins
groups of near copies by stars. A task sends a signature once for each batch that has it, with the
least of its members there, so a cluster that a third of all rows are in is few rows for any
reducer. Then the groups are gone through again, and only pairs from
different components are compared, and of these only such as counts of hashes by residue allow to
be similar. What is left out is linked already or not similar, so components are exact. Signatures
that many sets of a batch have are summed up for the reducer, by their components; their
members stay spread out and join only where the sums show several components. Of a large group, the
members of its largest component are compared with the others by blocks, never with each other.

Shingles are compared as 64-bit hashes; a collision would have to fall on a pair at the threshold.

Defined results: null or blank text has an empty set and is linked with nothing; a text with
fewer words than a shingle is one shingle; rows that repeat an id are one node, linked with all that
any of its texts is; rows with a null id are linked with nothing and their component is null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import bucketed, buckets_for, forget, saved, small_batches
from windrow.llm.components import components
from windrow.llm.packed import K1, K2, K3, by_bucket, mixed, pack, packed_schema, unpack
from windrow.sources.scratch import tidied
from windrow.sources.tables import table

#: Second-level cells of a part, and how many of them may differ.
CELLS, DIFFERENT = 3, 1
#: The share of signatures that the first round of comparisons uses.
STAR_SHARE = 8
#: Bound on the hot members that are broadcast by id, and the tasks that each one's set goes to.
MOST_HOT, SALTS = 1000, 32
#: Classes that a task remembers, to drop copies before the shuffle.
REMEMBER = 500_000

#: Sets of a batch with one signature, from which on they are summed up for the reducer.
MANY = 64
#: Members of a group that one task compares with as many others; larger groups go to more tasks.
MOST_MEMBERS = 2048
#: Residues of a profile; a power of two.
PROFILE = 128

_U = np.uint64


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, _U)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    m = min(n, len(w))
    h = np.full(len(w) - m + 1, _U(m))
    for j in range(m):
        h = (h ^ w[j : len(w) - m + 1 + j]) * K1
        h ^= h >> _U(29)
    return np.unique(mixed(h))


def class_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def profile(s: np.ndarray) -> bytes:
    """How many hashes of a set fall on each of ``PROFILE`` residues, 65,535 at most."""
    return np.minimum(np.bincount((s & _U(PROFILE - 1)).astype(np.int64), minlength=PROFILE), 65_535).astype(np.uint16).tobytes()


def overlap(size: int, num: int, den: int) -> int:
    """Least intersection of a set of ``size`` with any set as similar as num / den."""
    return -(-num * size // den)


def prefix(size: int, num: int, den: int) -> tuple[int, int]:
    """Length of a set's prefix, and how many of it a similar set has in its own prefix at least.

    Let ``m(size)`` be about half of ``spare = size - overlap``. The j-th smallest shingle that two
    similar sets share is preceded by ``spare`` others of each set at most, so the first ``m`` are
    in both prefixes of length ``spare + m``, where m is the smaller of both sets' own. The least
    partner has ``overlap`` shingles.
    """
    m = lambda n: max(1, (n - overlap(n, num, den)) // 2)
    return size - overlap(size, num, den) + m(size), m(overlap(size, num, den))


#: Made once in each Python process.
_STARTS: dict[tuple[int, int], np.ndarray] = {}


def band_starts(num: int, den: int) -> np.ndarray:
    if (num, den) not in _STARTS:
        starts = [1]
        while starts[-1] < 1 << 40:
            starts.append(starts[-1] * den // num + 1)
        _STARTS[num, den] = np.array(starts, dtype=np.int64)
    return _STARTS[num, den]


def parts(band: int, num: int, den: int, cells: int, different: int) -> tuple[int, int, int]:
    """n1, n2 and k2 of a band."""
    largest = int(band_starts(num, den)[band + 1]) - 1
    k = 2 * largest * (den - num) // (den + num)
    k2 = min(different, k)
    return -(-(k + 1) // (k2 + 1)), cells if k2 else 1, k2


def signatures(s: np.ndarray, num: int, den: int, cells: int = CELLS, different: int = DIFFERENT) -> np.ndarray:
    """PartEnum signatures of a sorted set of hashes, for its band and the next."""
    band = int(np.searchsorted(band_starts(num, den), len(s), side="right")) - 1
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed(s ^ K2), dtype=_U)])
    out = []
    for tag in (band, band + 1):
        n1, n2, k2 = parts(tag, num, den, cells, different)
        n = n1 * n2
        step = _U((1 << 64) // n) if n > 1 else _U(0)
        at = np.concatenate([[0], np.searchsorted(s, np.arange(1, n, dtype=_U) * step), [len(s)]])
        cell = mixed((sums[at[1:]] - sums[at[:-1]]) ^ (np.arange(1, n + 1, dtype=_U) * K1)).reshape(n1, n2)
        for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
            salt = _U(((c + 1) * int(K2) + (tag + 1) * int(K3)) % (1 << 64))
            out.append(mixed(cell[:, chosen].sum(axis=1, dtype=_U) + salt))
    return np.concatenate(out)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return den * both >= num * (len(a) + len(b) - both)


def _signed(b: pa.RecordBatch, num: int, den: int, cells: int, different: int, share: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a batch of ``id, label, set``, their ids and labels, in order, each once."""
    gs, ids, labels = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, label, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
        if not s:
            continue
        g = signatures(np.frombuffer(s, _U), num, den, cells, different)
        g = g[g % _U(share) == 0] if share > 1 else g
        gs.append(g)
        ids.append(np.full(len(g), i, np.int64))
        labels.append(np.full(len(g), label, np.int64))
    g, i, label = np.concatenate(gs), np.concatenate(ids), np.concatenate(labels)
    order = np.lexsort((i, g))
    g, i, label = g[order], i[order], label[order]
    fresh = _fresh(g, i)
    return g[fresh], i[fresh], label[fresh]


class Join:
    """One similarity join over the rows ``id, text`` of ``docs``."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, cells: int = CELLS, different: int = DIFFERENT, most_members: int = MOST_MEMBERS, many: int = MANY) -> None:
        self.docs, self.n, self.num, self.den, self.cells, self.different, self.most_members, self.many = docs, n, num, den, cells, different, most_members, many
        small_batches(docs.sparkSession)
        self.buckets = 1  # known when the classes are

    def classes(self) -> DataFrame:
        """``id, n_shingles, class``; class is null for empty sets."""
        n = self.n

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [shingles(t or b"", n) for t in b.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.binary())], ["id", "n_shingles", "class"])

        return self.docs.mapInArrow(f, "id long, n_shingles long, class binary")

    def hopeful(self) -> DataFrame:
        """``short``: the first eight bytes of classes that pass the prefix filter."""
        n, num, den, buckets = self.n, self.num, self.den, self.buckets
        shared = np.int64(-(1 << 63))  # stands for the classes that were told already

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                hs, cs = [], []
                for t in b.column(1).cast(pa.binary()).to_pylist():
                    s = shingles(t or b"", n)
                    if not len(s) or (c := int.from_bytes(class_of(s)[:8], "little", signed=True)) in seen:
                        continue
                    if len(seen) < REMEMBER:
                        seen.add(c)
                    p = s[: prefix(len(s), num, den)[0]]
                    hs.append(p)
                    cs.append(np.full(len(p), c, np.int64))
                if not hs:
                    continue
                h, c = np.concatenate(hs), np.concatenate(cs)
                order = np.lexsort((c, h))
                h, c = h[order], c[order]
                fresh = _fresh(h, c)
                h, c = h[fresh], c[fresh]
                # A shingle that several classes of this batch have is counted for them here and
                # sent once: what is sent of a hot one follows the batches, not the documents.
                _, starts, counts = np.unique(h, return_index=True, return_counts=True)
                many = np.repeat(counts > 1, counts)
                told, k = np.unique(c[many], return_counts=True)
                yield _kind(0, pack(buckets, np.concatenate([h[~many], h[starts[counts > 1]]]), np.concatenate([c[~many], np.full((counts > 1).sum(), shared)])))
                yield _kind(1, pack(buckets, told.view(_U), k.astype(np.int64)))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hs, cs, told, ks = [], [], [], []
            for b in batches:
                for k, x, y in zip(b.column(3).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    (hs if k == 0 else told).append(np.frombuffer(x, _U if k == 0 else np.int64))
                    (cs if k == 0 else ks).append(np.frombuffer(y, np.int64))
            out_c, out_k = told, ks
            if hs:
                h, c = np.concatenate(hs), np.concatenate(cs)
                order = np.lexsort((c, h))
                h, c = h[order], c[order]
                _, starts, counts = np.unique(h, return_index=True, return_counts=True)
                last = c[starts + counts - 1]
                many = np.repeat((c[starts] != last) | (c[starts] == shared), counts) & (c != shared)
                fresh = _fresh(h, c)
                out_c.append(c[many & fresh])
                out_k.append(np.ones(len(out_c[-1]), np.int64))
            if out_c:
                c, k = _summed(np.concatenate(out_c), np.concatenate(out_k))
                yield pack(buckets, c.view(_U), k)

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, k = _summed(*unpack(batches, "<i8", "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(k)], ["short", "k"])

        sent = self.docs.select("id", "text").mapInArrow(send, packed_schema(2) + ", kind tinyint")
        met = by_bucket(sent, buckets).mapInArrow(meet, packed_schema(2))
        return by_bucket(met, buckets).mapInArrow(total, "short long, k long")

    def sets(self, ids: DataFrame) -> DataFrame:
        """``id, n, profile, set`` of the rows whose id is in ``ids``, as a table bucketed by id:
        comparisons join it again and again, and it is never shuffled for that. The sets are a
        column beside the id, so a join by id leaves them in their buckets already."""
        n = self.n

        def f(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for t in texts:
                sets = [shingles((x or "").encode(), n) for x in t]
                yield pd.DataFrame({"n": [len(s) for s in sets], "profile": [profile(s) for s in sets], "set": [s.tobytes() for s in sets]})

        made = F.pandas_udf(f, "n long, profile binary, set binary")
        # Nothing bounds the ids, so they are never broadcast, at whatever size.
        rows = self.docs.join(ids.hint("merge"), "id", "left_semi").select("id", made("text").alias("s")).select("id", "s.*")
        return rows.sparkSession.table(bucketed(rows, "sets", self.buckets, "id")[0])

    def stars(self, labelled: DataFrame, share: int) -> DataFrame:
        """Pairs ``a, b`` of the least id with a signature and each other, from ``id, label, set``."""
        buckets, how = self.buckets, (self.num, self.den, self.cells, self.different)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                g, i, _ = _signed(b, *how, share)
                starts = np.flatnonzero(_fresh(g))
                yield _kind(0, pack(buckets, g[starts], i[starts]))
                firsts = np.repeat(i[starts], np.diff(np.append(starts, len(g))))
                yield _kind(1, _packed_pairs(buckets, firsts, i))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gs, ids = [b""], [b""]
            for b in batches:
                pairs = pa.compute.equal(b.column("kind"), 1)
                yield b.drop_columns(["kind"]).filter(pairs)
                rest = b.filter(pa.compute.invert(pairs))
                gs += rest.column("c0").to_pylist()
                ids += rest.column("c1").to_pylist()
            g, i = np.frombuffer(b"".join(gs), _U), np.frombuffer(b"".join(ids), np.int64)
            order = np.lexsort((i, g))
            g, i = g[order], i[order]
            starts = np.flatnonzero(_fresh(g))
            yield _packed_pairs(buckets, np.repeat(i[starts], np.diff(np.append(starts, len(g)))), i)

        sent = labelled.select("id", "label", "set").mapInArrow(send, packed_schema(2) + ", kind tinyint")
        return _pairs_once(by_bucket(sent, buckets).mapInArrow(meet, packed_schema(2)), buckets)

    def groups(self, labelled: DataFrame) -> DataFrame:
        """``name, id, label, size``: the members of groups of a signature with several labels among
        ``id, label, set``, where groups with the same members are one."""
        buckets, many, how = self.buckets, self.many, (self.num, self.den, self.cells, self.different)
        ddl = packed_schema(6) + ", kind tinyint"
        fields = pa.schema([("bucket", pa.int32()), *[(f"c{k}", pa.binary()) for k in range(6)], ("kind", pa.int8())])

        def wide(kind: int, b: pa.RecordBatch) -> pa.RecordBatch:
            none = [pa.nulls(b.num_rows, pa.binary())] * (7 - b.num_columns)
            return pa.RecordBatch.from_arrays([*b.columns, *none, pa.array([kind] * b.num_rows, pa.int8())], schema=fields)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                g, i, label = _signed(b, *how)
                if not len(g):
                    continue
                starts = np.flatnonzero(_fresh(g))
                counts = np.diff(np.append(starts, len(g)))
                hot = counts > many
                each = np.repeat(hot, counts)
                yield wide(0, pack(buckets, g[~each], i[~each], label[~each]))
                if hot.any():
                    yield wide(2, pack(buckets, i[each].view(_U), g[each], label[each]))
                    low, high, sums = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts), np.add.reduceat(mixed(i.view(_U) + K1), starts)
                    yield wide(1, pack(buckets, g[starts][hot], low[hot], high[hot], counts[hot], sums[hot]))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got: list[list[list[bytes]]] = [[[b""] for _ in range(5)] for _ in range(2)]
            for b in batches:
                for kind, *cols in zip(b.column("kind").to_pylist(), *(b.column(f"c{k}").to_pylist() for k in range(5)), strict=True):
                    for to, x in zip(got[kind], cols, strict=True):
                        to.append(x or b"")
            g, i, label = (np.frombuffer(b"".join(x), t) for x, t in zip(got[0], (_U, np.int64, np.int64), strict=False))
            h, low, high, some, sums = (np.frombuffer(b"".join(x), t) for x, t in zip(got[1], (_U, np.int64, np.int64, np.int64, _U), strict=True))
            order = np.lexsort((i, g))
            g, i, label = g[order], i[order], label[order]
            fresh = _fresh(g, i)
            g, i, label = g[fresh], i[fresh], label[fresh]
            # A member counts as a sum of one.
            all_g = np.concatenate([g, h])
            names, at = np.unique(all_g, return_inverse=True)
            if not len(names):
                return
            least, most = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
            np.minimum.at(least, at, np.concatenate([label, low]))
            np.maximum.at(most, at, np.concatenate([label, high]))
            size = np.zeros(len(names), np.int64)
            np.add.at(size, at, np.concatenate([np.ones(len(g), np.int64), some]))
            total = np.zeros(len(names), _U)
            np.add.at(total, at, np.concatenate([mixed(i.view(_U) + K1), sums]))
            name = (total + size.astype(_U)).view(np.int64)
            hot = np.zeros(len(names), bool)
            hot[at[len(g) :]] = True
            chosen = np.flatnonzero(least != most)
            chosen = chosen[np.unique(name[chosen], return_index=True)[1]]
            once = np.zeros(len(names), bool)
            once[chosen] = True
            member, to = once[at[: len(g)]], at[: len(g)]
            rows = [name[to][member], i[member], label[member], size[to][member]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.nulls(int(member.sum()), pa.int64())], ["name", "id", "label", "size", "hot"])
            k = np.flatnonzero(once & hot)  # whose other members are still to come
            yield pa.RecordBatch.from_arrays([pa.array(name[k]), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64()), pa.array(size[k]), pa.array(names[k].view(np.int64))], ["name", "id", "label", "size", "hot"])

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols = [np.frombuffer(b"".join(b.column(f"c{k}").to_pylist()), np.int64) for k in (1, 0, 2)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["hot", "id", "label"])

        sent = saved(labelled.select("id", "label", "set").mapInArrow(send, ddl), "signatures")
        met = saved(by_bucket(sent.filter("kind < 2"), buckets).mapInArrow(meet, "name long, id long, label long, size long, hot long"), "groups")
        members = met.filter("id is not null").select("name", "id", "label", "size")
        hot = met.filter("hot is not null").select("hot", "name", "size")
        if hot.isEmpty():
            return members.distinct()
        late = sent.filter("kind = 2").mapInArrow(spread, "hot long, id long, label long").join(hot, "hot")
        return members.unionAll(late.select("name", "id", "label", "size")).distinct()

    def blocks(self, members: DataFrame) -> DataFrame:
        """``name, p, q, block, id, label``: the members once for each comparison of two blocks. The
        largest component of a large group has blocks of its own, which only others are compared with."""
        most = self.most_members
        large = members.filter(F.col("size") > most).groupBy("name", "label").agg(F.count(F.lit(1)).alias("k"), F.max("size").alias("size"))
        large = large.groupBy("name").agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.max("size").alias("all"), F.max("k").alias("k"))
        few = F.coalesce(F.ceil((F.col("all") - F.col("k")) / most), F.lit(1)).cast("int")
        d = members.join(large, "name", "left").withColumns({"few": few, "rest": F.coalesce(F.ceil(F.col("k") / most), F.lit(0)).cast("int"), "minor": F.coalesce(F.col("label") != F.col("major"), F.lit(True))})
        nth = F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("few")).otherwise(F.col("rest"))).cast("int")
        d = d.withColumn("block", F.when(F.col("minor"), nth).otherwise(F.col("few") + nth))
        pair = lambda x, y: F.struct(x.alias("p"), y.alias("q"))
        to_few = F.sequence(F.lit(0), F.col("few") - 1)
        to_rest = F.when(F.col("rest") > 0, F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda j: pair(F.col("block"), F.col("few") + j))).otherwise(F.array().cast("array<struct<p:int,q:int>>"))
        minor = F.concat(F.transform(to_few, lambda j: pair(F.least("block", j), F.greatest("block", j))), to_rest)
        both = F.when(F.col("minor"), minor).otherwise(F.transform(to_few, lambda j: pair(j, F.col("block"))))
        return d.select("name", "id", "label", "block", F.explode(both).alias("t")).select("name", "t.p", "t.q", "block", "id", "label")

    def close(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs ``a, b`` of a group with different labels whose sizes and profiles allow a link:
        what two profiles differ by, two sets differ by at least."""
        num, den, buckets = self.num, self.den, self.buckets

        def compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """The pairs of whole groups, in order of their sizes within each."""
            p, q, block, ids, label, n = (t.column(k).to_numpy() for k in ("p", "q", "block", "id", "label", "n"))
            profiles = np.frombuffer(b"".join(t.column("profile").to_pylist()), np.uint16).reshape(-1, PROFILE).astype(np.int32)
            starts = np.flatnonzero(_fresh(t.column("name").to_numpy(), p, q))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            for s, e in zip(starts, [*starts[1:], len(p)], strict=True):
                for k in range(s, e - 1):  # sizes rise, so partners are those that follow, up to a size
                    far = s + np.searchsorted(n[s:e], den * n[k] // num, side="right")
                    at = np.arange(k + 1, far)
                    at = at[(label[at] != label[k]) & ((block[at] != block[k]) | (p[k] == q[k]))]
                    if len(at):
                        apart = np.abs(profiles[at] - profiles[k]).sum(axis=1, dtype=np.int64)
                        at = at[(den + num) * apart <= (den - num) * (n[at] + n[k])]
                        if len(at):
                            found.append((np.full(len(at), ids[k]), ids[at]))
                            held += len(at)
                if held > 500_000:
                    yield _packed_pairs(buckets, *map(np.concatenate, zip(*found, strict=True)))
                    found, held = [], 0
            if found:
                yield _packed_pairs(buckets, *map(np.concatenate, zip(*found, strict=True)))

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: pa.Table | None = None  # a group that the next batch may go on with
            for b in batches:
                t = pa.Table.from_batches([b])
                t = t if held is None else pa.concat_tables([held, t])
                starts = np.flatnonzero(_fresh(*(t.column(k).to_numpy() for k in ("name", "p", "q"))))
                whole = int(starts[-1]) if len(starts) else 0
                yield from compared(t.slice(0, whole)) if whole else ()
                held = t.slice(whole).combine_chunks()
            if held is not None and held.num_rows:
                yield from compared(held)

        rows = self.blocks(members).join(sets.select("id", "n", "profile"), "id").select("name", "p", "q", "block", "id", "label", "n", "profile")
        return _pairs_once(rows.repartition("name", "p", "q").sortWithinPartitions("name", "p", "q", "n").mapInArrow(f, packed_schema(2)), buckets)

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs ``a, b`` that are similar."""
        num, den = self.num, self.den

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = [similar(np.frombuffer(x, _U), np.frombuffer(y, _U), num, den) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        # Members of pairs that very many share are few, and their sets go to several tasks.
        hot = F.broadcast(pairs.groupBy("a").count().filter(F.col("count") * MOST_HOT > pairs.count()).select(F.col("a").alias("hot")))
        x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
        marked = pairs.join(hot, F.col("a") == F.col("hot"), "left")
        cold = marked.filter("hot is null").select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y")
        salted = x.join(hot, F.col("a") == F.col("hot")).select("a", "x", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        warm = marked.filter("hot is not null").select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")).join(y, "b").join(salted, ["a", "salt"]).select("a", "b", "x", "y")
        return cold.unionAll(warm).mapInArrow(f, "a long, b long")

    def run(self) -> DataFrame:
        """``id, n_shingles, component`` for each row."""
        docs = saved(self.classes(), "classes")
        spark, known = docs.sparkSession, docs.filter(F.col("id").isNotNull())
        self.buckets = buckets_for(spark, 8 * (docs.agg(F.sum("n_shingles")).first()[0] or 0))
        named = known.filter(F.col("class").isNotNull())
        reps = named.groupBy("class").agg(F.min("id").alias("id"), F.min("n_shingles").alias("n_shingles"))
        reps = saved(reps, "class-reps")
        own = self.repeated(known, reps)
        need = _needed(reps, self.num, self.den)
        hopeful = saved(need.join(self.hopeful(), "short").filter("k >= m").select("id").distinct(), "hopeful")
        sets = self.sets(hopeful)
        stars = saved(self.stars(sets.withColumn("label", F.col("id")), STAR_SHARE), "stars")
        first = saved(own.unionAll(self.linked(stars, sets)), "links")
        linked = saved(components(first), "components")
        labelled = sets.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("label"), "set")
        members = saved(self.groups(labelled), "members")
        rest = saved(self.close(members, sets), "pairs")
        more = self.linked(rest, sets)
        linked = saved(components(first.unionAll(more)), "components")
        for t in (stars, first, members, rest, hopeful):
            forget(t)
        to = reps.select("class", F.col("id").alias("rep")).join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
        some = docs.filter(F.col("class").isNotNull()).join(to, "class", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
        none = docs.filter(F.col("class").isNull()).join(linked, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
        return some.unionAll(none)

    def repeated(self, known: DataFrame, reps: DataFrame) -> DataFrame:
        """Links ``a, b`` of the ids that have several texts with the least id of each of these."""
        h = F.xxhash64("class")  # the same for all empty texts
        several = known.groupBy("id").agg(F.min(h).alias("x"), F.max(h).alias("y")).filter("x <> y").select("id")
        several = saved(several, "repeated-ids")
        links = known.join(several, "id").select("id", "class").join(reps.select("class", F.col("id").alias("rep")), "class")
        return links.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()


def _kind(k: int, b: pa.RecordBatch) -> pa.RecordBatch:
    """A packed batch of two columns, marked."""
    return pa.RecordBatch.from_arrays([*b.columns, pa.array([k] * b.num_rows, pa.int8())], ["bucket", "c0", "c1", "kind"])


def _fresh(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where rows in order differ from the row before."""
    out = np.zeros(len(sorted_columns[0]), bool)
    out[:1] = True
    for c in sorted_columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _needed(reps: DataFrame, num: int, den: int) -> DataFrame:
    """``id, short, m``: the name that the prefix filter uses, and how many shared shingles it asks for."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = [int.from_bytes(c[:8], "little", signed=True) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(short, pa.int64()), pa.array([prefix(n, num, den)[1] for n in b.column(2).to_pylist()], pa.int64())], ["id", "short", "m"])

    return reps.select("id", "class", "n_shingles").mapInArrow(f, "id long, short long, m long")


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(keys, return_inverse=True)
    return k, np.bincount(at, weights=counts, minlength=len(k)).astype(np.int64)


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of different ids, the lesser first."""
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = _fresh(a, b)
    return a[fresh], b[fresh]


def _packed_pairs(buckets: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, dealt out by both."""
    a, b = _unique_pairs(a, b)
    return pack(buckets, mixed(a.view(_U)) + b.view(_U) * K1, a, b, send_keys=False)


def _pairs_once(packed: DataFrame, buckets: int) -> DataFrame:
    """Rows ``a, b`` of the pairs that tasks have sent, each of them once."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _unique_pairs(*unpack(batches, "<i8", "<i8"))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return by_bucket(packed, buckets).mapInArrow(f, "a long, b long")


@tidied
def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, cells: int = CELLS, different: int = DIFFERENT, most_members: int = MOST_MEMBERS, many: int = MANY) -> DataFrame:
    """``id, n_shingles, component``: groups by links of Jaccard similarity num / den or more."""
    return Join(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), n, num, den, cells, different, most_members, many).run()


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = similar_groups(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return g.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id
"""
