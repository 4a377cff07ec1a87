"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text's paragraphs are its lines, cut further behind words whose hash is a multiple of ``CUT``, so
that a long line is cut alike wherever it stands. They are hashed to 64-bit keys, a set. A sketch has
``CELLS`` cells in
four equal parts; each key is added to one cell of each part, as a count, the XOR of the keys and
the XOR of 32-bit checks of the keys. Two sketches subtract cell by cell; what both texts have
cancels, and peeling recovers the keys that differ: a cell that holds one key gives it away, and
it is taken out of its other cells. The likeness of two texts is the Jaccard likeness of their
key sets, known from the counts of recovered keys. The keys that the edited text has lost and gained
are returned.

Where peeling gets stuck, the keys are dealt to sub-tables of ``CELLS`` cells, one for about eight
keys and twice as many on each further try. Pairs of up to ``HERE`` keys are peeled so where they
are, ``TRIES_HERE`` times; longer ones, and what is stuck even then, are dealt out over all tasks by
pair and sub-table, and only the sub-tables that got stuck are tried again. The work is linear in the
length of the text. After ``TRIES`` tries the differing keys are counted directly.

The next document comes from a window within ranges of ids, which quantiles of the ids bound, so
that they hold about as many rows each. An id that very many rows repeat, and rows without one, are
cut further by a hash of the text. Each range also gets a copy of the
first row of the next range; there is one such row for each of at most ``MOST_RANGES`` ranges and
``SLICES`` for each of ``MOST_BOUNDS`` such ids,
which bounds what is broadcast. Texts are shuffled once.

Defined results: null text counts as empty, and the empty text is one empty paragraph; a null id
comes after all others; rows that repeat an id follow each other; a single document is its own
next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from windrow.llm.common import partitions, saved
from windrow.operators.ranking import range_of
from windrow.sources.scratch import tidied
from windrow.sources.tables import table

CELLS, PARTS = 24, 4
CUT = 64
ROUNDS = 10
TRIES = 8
#: Keys of a pair that are peeled in its own row, and how often that is tried.
HERE, TRIES_HERE = 256, 4
ROWS_PER_RANGE, MOST_RANGES, MOST_BOUNDS = 250, 65_536, 1000
SLICES = 64

_CHECK = 977


def paragraph_keys(text: Column) -> Column:
    """The set of keys of a text's paragraphs."""
    words = F.transform(F.split(text, " "), lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(CUT)) == 0, F.concat(w, F.lit("\n"))).otherwise(w))
    return F.array_distinct(F.transform(F.split(F.array_join(words, " "), "\n"), lambda p: F.xxhash64(p)))


def check(key: Column) -> Column:
    return F.xxhash64(F.lit(_CHECK), key).bitwiseAND(F.lit(0xFFFFFFFF))


def _placed(key: Column, sign: Column, seed: Column) -> Column:
    """A key with its check and its cells, a bit for each."""
    u = F.xxhash64(seed, key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(u, 16 * j), F.lit(CELLS // PARTS)).cast("int") + j * (CELLS // PARTS)) for j in range(PARTS)]
    return F.struct(key.alias("k"), check(key).alias("c"), sign.alias("s"), reduce(Column.bitwiseOR, bits).alias("m"))


def _added(placed: Column, i: Column, start: Column, sign: int = 1) -> Column:
    """Cell ``start``, the i-th, with those of an array of placed keys that are in it added, or taken out."""
    n = lambda a, x: a["n"] + x["s"] if sign > 0 else a["n"] - x["s"]
    more = lambda a, x: F.struct(n(a, x).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["c"].bitwiseXOR(x["c"]).alias("c"))
    return F.aggregate(placed, start, lambda a, x: F.when(F.call_function("bit_get", x["m"], i) == 1, more(a, x)).otherwise(a))


def _cells(placed: Column) -> Column:
    """The cells of an array of placed keys."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: _added(placed, i, none))


def sketch(keys: Column) -> Column:
    """The cells ``n, k, c`` of a set of keys."""
    return _let(F.transform(keys, lambda k: _placed(k, F.lit(1), F.lit(0))), _cells)


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peeled(difference: Column, seed: Column) -> Column:
    """``cells, plus, minus``: what is left, and the keys of either side that came out."""

    def step(acc: Column, _: Column) -> Column:
        alone = F.filter(acc["cells"], lambda c: (F.abs(c["n"]) == 1) & (check(c["k"]) == c["c"]))
        found = F.array_distinct(F.transform(alone, lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n"))))

        def take(keys: Column) -> Column:
            rest = _let(F.transform(keys, lambda x: _placed(x["k"], x["n"], seed)), lambda placed: F.transform(acc["cells"], lambda c, i: _added(placed, i, c, -1)))
            more = lambda side, sign: F.concat(acc[side], F.transform(F.filter(keys, lambda x: x["n"] == sign), lambda x: x["k"])).alias(side)
            over = F.struct(acc["cells"].alias("cells"), acc["plus"].alias("plus"), acc["minus"].alias("minus"), F.lit(True).alias("over"))
            return F.when(F.size(keys) == 0, over).otherwise(F.struct(rest.alias("cells"), more("plus", 1), more("minus", -1), F.lit(False).alias("over")))

        return F.when(acc["over"], acc).otherwise(_let(found, take))

    none = F.array().cast("array<long>")
    start = F.struct(difference.alias("cells"), none.alias("plus"), none.alias("minus"), F.lit(False).alias("over"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def signed(keys: Column, others: Column) -> Column:
    """Keys of both sides with their signs."""
    side = lambda ks, sign: F.transform(ks, lambda k: F.struct(k.alias("k"), F.lit(sign).alias("s")))
    return F.concat(side(keys, 1), side(others, -1))


def sub_tables(n: Column, t: Column) -> Column:
    """How many sub-tables ``n`` keys are dealt to on try ``t``: one, the sketch itself, on try 0."""
    return F.when(t == 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(n * F.pow(F.lit(2.0), t - 1) / 8))).cast("long")


def recovered_here(cells: Column, keys: Column, others: Column, other_cells: Column) -> Column:
    """``ok, plus, minus`` of a pair in one row: from its two sketches, or else by larger ones."""
    n = F.size(keys) + F.size(others)

    def step(acc: Column, t: Column) -> Column:
        tables = sub_tables(n, t)
        deal = _let(tables, lambda m: F.transform(signed(keys, others), lambda x: F.struct(_placed(x["k"], x["s"], t).alias("x"), F.pmod(F.xxhash64(-t, x["k"]), m).alias("sub"))))
        own = lambda d, sub: F.transform(F.filter(d, lambda y: y["sub"] == sub), lambda y: y["x"])
        cells_of = lambda d, sub: F.when(t == 0, minus(cells, other_cells)).otherwise(_let(own(d, sub), _cells))
        tried = _let(F.when(t > 0, deal), lambda d: F.transform(F.sequence(F.lit(0).cast("long"), tables - 1), lambda sub: peeled(cells_of(d, sub), t)))

        def whole(rs: Column) -> Column:
            side = lambda c: F.flatten(F.transform(rs, lambda r: r[c])).alias(c)
            return F.struct(F.forall(rs, lambda r: empty(r["cells"])).alias("ok"), side("plus"), side("minus"))

        return F.when(acc["ok"] | ((t > 0) & (n > HERE)), acc).otherwise(_let(tried, whole))

    none = F.array().cast("array<long>")
    return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES_HERE)), F.struct(F.lit(False).alias("ok"), none.alias("plus"), none.alias("minus")), step)


def empty(cells: Column) -> Column:
    return ~F.exists(cells, lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["c"] != 0))


def as_text(cells: Column) -> Column:
    """A sketch as a string: for each cell its count, keys and checks in hexadecimal."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.lower(F.hex(c["n"])), F.lit("."), F.lpad(F.lower(F.hex(c["k"])), 16, "0"), F.lpad(F.lower(F.hex(c["c"])), 8, "0"))), "-")


def likeness(n: Column, plus: Column, minus_: Column) -> Column:
    """Jaccard likeness of a set of ``n`` keys to another, from the keys that only one has."""
    return (n - plus) / (n + minus_)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, WindowSpec]:
    """``extra, doc_id, text`` in windows, where each row that isn't extra is followed by the next
    document in ascending order of ids, the last by the first."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = d.count()
    ranges = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE))
    parts = min(ranges, MOST_BOUNDS)
    quantiles = d.agg(F.percentile_approx("doc_id", [k / parts for k in range(parts + 1)], 10_000)).first()[0] or [0]
    bounds = sorted(set(quantiles))
    heavy = [x for x, y in zip(quantiles, quantiles[1:], strict=False) if x == y]
    # A range is cut by the hash for an id that fills it, and for null; other ids of it come after that.
    cut = F.col("doc_id").isNull() | F.col("doc_id").isin(heavy) if heavy else F.col("doc_id").isNull()
    piece = F.when(cut, F.shiftright("h", 58) + SLICES // 2).otherwise(F.lit(SLICES)).cast("long")
    base = F.coalesce(range_of(F.col("doc_id"), bounds, -(-ranges // parts)), F.lit((len(bounds) + 1) * (-(-ranges // parts))).cast("long"))
    d = d.withColumn("range", base * (2 * SLICES) + piece)
    firsts = d.groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    order = Window.orderBy("range")
    firsts = firsts.select(F.col("range").alias("of"), F.col("first.doc_id").alias("i_"), F.col("first.h").alias("h_"), F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())).alias("before"))
    d = d.join(F.broadcast(firsts), (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("i_")) & (F.col("h") == F.col("h_")), "left")  # one row for each range
    here = F.struct(F.col("range"), F.lit(0).alias("extra"))
    places = F.when(F.col("of").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("before").alias("range"), F.lit(1).alias("extra"))))
    dealt = d.select("doc_id", "h", "text", F.explode(places).alias("at")).select("at.range", "at.extra", "doc_id", "h", "text").repartition("range")
    return dealt, Window.partitionBy("range").orderBy("extra", F.col("doc_id").asc_nulls_last(), "h")


@tidied
def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: its fingerprint, that of its edited text, two likenesses, and the keys of
    the paragraphs that the edited text has lost and gained."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    dealt, following = with_next(docs, id_col, text_col)
    here = lambda c: F.when(F.col("extra") == 0, c)
    made = (
        dealt.withColumn("next_text", F.lead("text").over(following))
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", here(F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))))
        .select("range", "extra", "doc_id", "h", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), paragraph_keys(F.col("text")).alias("keys"), here(paragraph_keys(F.col("edited"))).alias("edited_keys"))
        .withColumns({"cells": sketch(F.col("keys")), "edited_cells": here(sketch(F.col("edited_keys")))})
        .withColumns({"next_keys": F.lead("keys").over(following), "next_cells": F.lead("cells").over(following)})
        .filter("extra = 0")
        # Both pairs by one expression: it is large, and plans are gone through node by node.
        .withColumn("both", F.transform(F.array(F.struct(F.col("edited_keys").alias("k"), F.col("edited_cells").alias("c")), F.struct(F.col("next_keys").alias("k"), F.col("next_cells").alias("c"))), lambda v: recovered_here(F.col("cells"), F.col("keys"), v["k"], v["c"])))
        .withColumns({"e": F.get("both", F.lit(0)), "x": F.get("both", F.lit(1))})
    )
    open_ = ~F.col("e.ok") | ~F.col("x.ok")
    near = lambda r: F.when(F.col(f"{r}.ok"), likeness(F.size("keys"), F.size(f"{r}.plus"), F.size(f"{r}.minus")))
    main = saved(
        made.select(
            "doc_id", "n_chars", "edited_sha256", as_text(F.col("cells")).alias("fingerprint"), as_text(F.col("edited_cells")).alias("edited_fingerprint"),
            near("e").alias("near_edited"), near("x").alias("near_next"), F.when(F.col("e.ok"), F.col("e.plus")).alias("lost"), F.when(F.col("e.ok"), F.col("e.minus")).alias("gained"),
            F.when(open_, F.col("keys")).alias("keys"), F.when(~F.col("e.ok"), F.col("edited_keys")).alias("edited_keys"), F.when(~F.col("x.ok"), F.col("next_keys")).alias("next_keys"),
        ),
        "fingerprints",
    )
    stuck = main.filter("keys is not null").select("keys", F.explode(F.array("edited_keys", "next_keys")).alias("others")).filter(F.col("others").isNotNull())
    if stuck.isEmpty():
        return main.drop("keys", "edited_keys", "next_keys")
    done = saved(recovered(saved(stuck.select(*_pair(), "keys", "others").dropDuplicates(["x", "y"]), "stuck")), "recovered")
    out = main
    for col, others in (("near_edited", "edited_keys"), ("near_next", "next_keys")):
        got = done.select("x", "y", F.col("plus").alias("plus_"), F.col("minus").alias("minus_"))
        out = out.withColumns({"x_": F.xxhash64("keys"), "y_": F.xxhash64(others)}).join(got, F.col(others).isNotNull() & (F.col("x_") == got["x"]) & (F.col("y_") == got["y"]), "left")
        out = out.withColumn(col, F.coalesce(col, likeness(F.size("keys"), F.size("plus_"), F.size("minus_"))))
        if col == "near_edited":
            out = out.withColumns({"lost": F.coalesce("lost", "plus_"), "gained": F.coalesce("gained", "minus_")})
        out = out.drop("x_", "y_", "x", "y", "plus_", "minus_")
    return out.drop("keys", "edited_keys", "next_keys")


def _pair() -> tuple[Column, Column]:
    return F.xxhash64("keys").alias("x"), F.xxhash64("others").alias("y")


def recovered(pairs: DataFrame, tries: int = TRIES) -> DataFrame:
    """``x, y, plus, minus`` of the pairs ``x, y, keys, others`` of key sets, by ever larger sketches."""
    n = F.size("keys") + F.size("others")
    left = pairs.select("x", "y", n.alias("n"), F.explode(signed(F.col("keys"), F.col("others"))).alias("e"))
    out = [pairs.select("x", "y", F.array().cast("array<long>").alias("plus"), F.array().cast("array<long>").alias("minus"))]
    for t in range(1, tries + 1):
        keys = left.select("x", "y", "n", "e", F.pmod(F.xxhash64(F.lit(-t), "e.k"), sub_tables(F.col("n"), F.lit(t))).alias("sub"))
        # Peeling costs far more than its bytes say: tasks are not to be merged by size.
        subs = keys.repartition(partitions(pairs.sparkSession), "x", "y", "sub").groupBy("x", "y", "n", "sub").agg(F.collect_list("e").alias("es"))
        tried = subs.withColumn("r", peeled(_let(F.transform("es", lambda e: _placed(e["k"], e["s"], F.lit(t))), _cells), F.lit(t))).withColumn("ok", empty(F.col("r.cells")))
        tried = saved(tried.select("x", "y", "n", "ok", "r.plus", "r.minus", F.when(~F.col("ok"), F.col("es")).alias("es")), "peeled")
        out.append(tried.filter("ok").select("x", "y", "plus", "minus"))
        left = tried.filter("not ok").select("x", "y", "n", F.explode("es").alias("e"))
        if left.isEmpty():
            break
    rest = left.groupBy("x", "y", F.col("e.k").alias("k")).agg(F.sum("e.s").alias("s"))
    only = lambda sign: F.when(F.col("s") == sign, F.array("k")).otherwise(F.array().cast("array<long>"))
    out.append(rest.select("x", "y", only(1).alias("plus"), only(-1).alias("minus")))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionAll(o)
    both = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return whole.groupBy("x", "y").agg(both("plus"), both("minus"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
