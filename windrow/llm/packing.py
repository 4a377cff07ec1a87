"""Best-fit packing into bins of several permitted lengths.

A sequence of ``c`` tokens costs ``c + c * c / ATTENTION``: the part that is linear in its length
and the part that is square. Pieces go, longest first, to the open bin that they leave the least
room in. Where none has room, each permitted length is filled on trial with the pieces still to
come, the longest that fits first, and the one is opened that costs least for each token it then
holds. At the end each bin shrinks to the least permitted length that holds its contents. A trial
can't tell which of these pieces go to other bins, so the shard is also packed with the least
length that holds the piece that opens a bin; the cheaper of both packings is taken.

Pieces are dealt to shards by the place of their row in the written table of lengths and by their
number, so that neither repeated rows nor the many pieces of one text meet in a shard; a shard has
about ``PIECES_PER_SHARD`` at most and is packed
by itself: only ids and lengths move, and no task depends on how the ids are distributed. Each
shard leaves at most a few bins half full.

Defined results: a text longer than the largest length is split into pieces of that length and a
rest; a text without tokens is one piece of length 0 in no bin (bin null, capacity 0); null text
has no tokens; repeated rows and null ids are packed like any other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import n_words, saved
from windrow.sources.scratch import tidied
from windrow.sources.tables import table

CAPACITIES = (256, 512, 1024, 2048, 4096)
ATTENTION = 16_384
#: Pieces that one task packs, on average at most.
PIECES_PER_SHARD = 50_000


def cost(c: int, attention: int = ATTENTION) -> float:
    return c + c * c / attention


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """For lengths in falling order: bin and offset of each, and the final length of each bin."""
    capacities = tuple(sorted(capacities))
    tried = [_packed(lengths, capacities, attention, least) for least in (True, False)]
    return min(tried, key=lambda t: sum(cost(c, attention) for c in t[2]))


def _filled(n: int, c: int, count: list[int], some: int) -> int:
    """Tokens in a bin of length ``c`` with a piece of ``n`` and the longest others that fit."""
    room = c - n
    while room and (fits := some & ((1 << (room + 1)) - 1)):
        k = fits.bit_length() - 1
        room -= k * min(count[k], room // k)
        some &= (1 << k) - 1
    return c - room


def _packed(lengths: list[int], capacities: tuple[int, ...], attention: int, least: bool) -> tuple[list[int], list[int], list[int]]:
    costs = {c: cost(c, attention) for c in capacities}
    room: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # open bins by the room they have
    some = 0  # bit r: room[r] isn't empty
    count = [0] * (capacities[-1] + 1)  # pieces still to come by their length
    for n in lengths:
        count[n] += 1
    to_come = sum(1 << n for n, k in enumerate(count) if k)  # bit n: count[n] isn't 0
    size, used, bins, offsets = [], [], [], []
    for n in lengths:
        count[n] -= 1
        if not count[n]:
            to_come &= ~(1 << n)
        if fits := some >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            r = min((c for c in capacities if c >= n), key=lambda c: c if least else (costs[c] / _filled(n, c, count, to_come), c))
            b = len(size)
            size.append(r)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if left := r - n:
            room[left].append(b)
            some |= 1 << left
    return bins, offsets, [next(c for c in capacities if c >= u) for u in used]


@tidied
def pack(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES,
         attention: int = ATTENTION, pieces_per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """``id, piece, start, n_tokens, bin, bin_offset, capacity``: where each piece went."""
    most = max(capacities)
    # Written, so that a row has the same place whenever a task is run again.
    d = saved(lengths.select(F.col(id_col).cast("long").alias("id"), F.col(length_col).cast("long").alias("n")), "lengths")
    d = d.withColumn("n", F.coalesce("n", F.lit(0)))
    last = F.greatest(F.lit(0), F.floor((F.col("n") - 1) / most)).cast("long")
    shards = max(1, -(-(d.agg(F.sum(last + 1)).first()[0] or 0) // pieces_per_shard))
    pieces = d.select("id", "n", F.monotonically_increasing_id().alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    dealt = pieces.select(
        "id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("long").alias("n_tokens"),
        F.pmod(F.xxhash64(F.lit(3), "row", "piece"), F.lit(shards)).alias("shard"),
    )

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        full = pdf["n_tokens"] > 0
        bins, offsets, sizes = best_fit(pdf.loc[full, "n_tokens"].tolist(), capacities, attention)
        none = len(pdf) - len(bins)
        base = int(pdf["shard"].iloc[0]) << 32
        pdf["bin"] = pd.array([base + b for b in bins] + [None] * none, dtype="Int64")
        pdf["bin_offset"] = offsets + [0] * none
        pdf["capacity"] = [sizes[b] for b in bins] + [0] * none
        pdf["id"] = pdf["id"].astype("Int64")
        return pdf[["id", "piece", "start", "n_tokens", "bin", "bin_offset", "capacity"]]

    return dealt.groupBy("shard").applyInPandas(shard, "id long, piece long, start long, n_tokens long, bin long, bin_offset long, capacity long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs.select("doc_id", n_words(F.col("text")).alias("n_tokens"))).withColumnRenamed("id", "doc_id")
