"""Quality classifier: a generalised additive model with pairwise interactions.

Features are measured on the whole text and cut into bins at quantiles of the training rows. In
each cycle every feature in turn gets a shallow tree (at most four leaves over its ordered bins)
fitted to the current gradient of the log loss, and a small step of it is added to the feature's
table; then the pairs of features whose residual differs most over a coarse grid get tables in
the same way, from trees of one cut on either axis. A score is the sum of one entry from each
table.

Training rows: labels whose crc32(id) mod 3 is not 1, at most ``MOST_ROWS`` of them, those with
the smallest hash of the id. That bounds what is broadcast. Features of the texts with these ids are
measured by the executors; of as many rows as repeat an id, those with the smallest hash of the text
are taken, ``MOST_ROWS`` in all, and only their features reach the driver. Scoring is
a map over all documents.

Defined results: null text counts as empty; an empty text has features of its own and a score;
null labels are skipped; repeated labels, and documents that repeat an id, are rows of their own; without training rows of both
classes every score is the share of label 1, 0.5 if there is none; a null id is not held out;
other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import small_batches
from windrow.sources.tables import table

#: Bound on the labelled rows that training reads.
MOST_ROWS = 12_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
CYCLES = 60
PAIR_CYCLES = 30
STEP = 0.15
#: L2 penalty on a leaf, in units of its curvature.
RIDGE = 1.0

FEATURES = (
    "log_bytes", "upper", "digit", "space", "high", "bang", "pipe", "symbol", "comma", "stop", "other_mark", "entropy",
    "word_length", "distinct_words", "top_word", "repeats", "log_lines", "distinct_lines", "line_length", "mark_ends", "lower_words",
)

_CLASS = np.zeros(256, dtype=np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r", bytes(range(128, 256)), b"!", b"|", b"#$%&*@^~<>{}[]\\=+_", b",;:", b".?", b"\"'()-/`"), 1):
    _CLASS[list(_chars)] = _i


def features(text: bytes) -> list[float]:
    """The values of ``FEATURES`` for one text, in that order."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=11)[1:] / max(n, 1)
    p = counts[counts > 0] / max(n, 1)
    words = text.split()
    lines = text.split(b"\n")
    m = max(len(words), 1)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(n), *share, float(-(p * np.log2(p)).sum()), sum(map(len, words)) / m, len(seen) / m if words else 1.0, max(seen.values(), default=0) / m, same / m,
        np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        sum(w[-1] < 48 for w in words) / m, sum(map(bytes.islower, words)) / m,
    ]


def feature_rows(texts: pd.Series) -> np.ndarray:
    return np.array([features((t or "").encode()) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class Model:
    """Tables by feature and by pair of features; ``base`` is what every score starts from."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            z += t[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradients ``g`` and curvatures ``h``."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over ordered bins: the value of its leaf for each bin."""
    spans = [(0, len(g))]
    for _ in range(2):
        halves = []
        for a, b in spans:
            gain, k = _best_cut(g[a:b], h[a:b])
            halves += [(a, a + k), (a + k, b)] if gain > 1e-9 else [(a, b)]
        spans = halves
    out = np.empty(len(g))
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on either axis of a grid."""
    cg, ch = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    tg, th, best, at = cg[-1, -1], ch[-1, -1], -1.0, (0, 0)
    part = lambda q, r: q**2 / (r + RIDGE)
    a, b = slice(1, -1), slice(1, -1)
    top, left = cg[-1:, b], cg[a, -1:]
    toph, lefth = ch[-1:, b], ch[a, -1:]
    if g.shape[0] > 1 and g.shape[1] > 1:
        x, xh = cg[a, b], ch[a, b]
        gain = part(x, xh) + part(top - x, toph - xh) + part(left - x, lefth - xh) + part(tg - top - left + x, th - toph - lefth + xh)
        at = np.unravel_index(int(gain.argmax()), gain.shape)
        best = float(gain[at])
    i, j = at[0] + 1, at[1] + 1
    out = np.zeros_like(g)
    for s in ((slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))):
        out[s] = g[s].sum() / (h[s].sum() + RIDGE)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables in cycles; the order of the rows doesn't matter."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return Model(float(np.log(share / (1 - share))), [], [], [], [], [])
    n_f = x.shape[1]
    edges, coarse = [_edges(x[:, f], BINS) for f in range(n_f)], [_edges(x[:, f], PAIR_BINS) for f in range(n_f)]
    bins = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(n_f)]
    rough = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(n_f)]
    share = y.mean()
    m = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [])
    z = np.full(len(y), m.base)
    for _ in range(CYCLES):
        for f in range(n_f):
            p = 1 / (1 + np.exp(-z))
            k = len(edges[f]) + 1
            add = STEP * _tree(np.bincount(bins[f], y - p, k), np.bincount(bins[f], p * (1 - p), k))
            m.tables[f] += add
            z += add[bins[f]]

    def grid(a: int, b: int) -> tuple[float, np.ndarray]:
        p, ka, kb = 1 / (1 + np.exp(-z)), len(coarse[a]) + 1, len(coarse[b]) + 1
        flat = rough[a] * kb + rough[b]
        return _cross(np.bincount(flat, y - p, ka * kb).reshape(ka, kb), np.bincount(flat, p * (1 - p), ka * kb).reshape(ka, kb))

    ranked = sorted(((grid(a, b)[0], a, b) for a in range(n_f) for b in range(a + 1, n_f)), reverse=True)
    m.pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain > 0]
    m.pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in m.pairs]
    for _ in range(PAIR_CYCLES):
        for t, (a, b) in zip(m.pair_tables, m.pairs, strict=True):
            add = STEP * grid(a, b)[1]
            t += add
            z += add[rough[a], rough[b]]
    return m


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """Fit on the labelled rows that aren't held out, ``most_rows`` at most."""
    small_batches(docs.sparkSession)
    i = F.col(id_col)
    rows = labels.select(i.alias("id_"), F.col(label_col).cast("int").alias("label_")).filter(F.col("label_").isin(0, 1) & i.isNotNull() & ~held_out(i))
    rows = rows.orderBy(F.xxhash64(F.lit(9), "id_"), "id_", "label_").limit(most_rows)
    picked = docs.select(i.alias("id2_"), F.coalesce(F.col(text_col), F.lit("")).alias("t_")).join(F.broadcast(rows), F.col("id2_") == F.col("id_"))  # bounded by most_rows

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id_"], "label": b["label_"], "h": b["h_"], "x": list(feature_rows(b["t_"]))})

    measured = picked.withColumn("h_", F.xxhash64("t_")).mapInPandas(measure, "id long, label int, h long, x array<double>")
    got = measured.orderBy(F.xxhash64(F.lit(9), "id"), "id", "h", "label").limit(most_rows).collect()  # bounded by most_rows
    return fit(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in got], dtype=float))


def held_out(i) -> F.Column:
    return F.coalesce(F.crc32(i.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` as structs ``doc`` with ``score``."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(np.concatenate([model.score(feature_rows(t[k : k + 1000])) for k in range(0, len(t), 1000)] or [np.zeros(0)]))

    return docs.select(F.struct("*").alias("doc"), score(F.coalesce(F.col(text_col), F.lit(""))).alias("score"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    i = F.col("doc.doc_id")
    return s.select(i.alias("doc_id"), held_out(i).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
