"""A corpus from ``documents`` to packed training sequences, in five stages.

Each stage takes all rows that the one before kept and returns the columns of ``documents``; the
last returns where each piece of text went.

Defined results: null and empty texts are scored like others and pass by that score; they are no one's
near duplicate, the mix takes nothing of them, and so they reach no bin. Rows that repeat an id are
scored and deduplicated by lines as one document; of near duplicates all rows of the id that stands for its
group stay, and all rows of other ids go. Null ids are near no one. Columns of ``documents`` beyond
the five go through unchanged, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm import jaccard, lines, mixing, packing, quality
from windrow.llm.common import n_words, saved
from windrow.sources.scratch import scratch, tidied, tidy
from windrow.sources.tables import table

#: Scores below this are rejected.
LEAST_SCORE = 0.5
#: Near duplicates: words of a shingle, similarity in hundredths.
SHINGLE, SIMILARITY = 5, 80
#: At this similarity, parts of four cells of which two may differ.
CELLS, DIFFERENT = 4, 2


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).filter(F.col("score") >= LEAST_SCORE).select("doc.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has."""
    d = lines.dedup_lines(docs)
    kept = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return d.select(*[kept.get(c, F.col(f"doc.{c}")).alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    groups = jaccard.similar_groups(docs, n=SHINGLE, num=SIMILARITY, den=100, cells=CELLS, different=DIFFERENT)
    gone = saved(groups.filter("id <> component").select(F.col("id").alias("doc_id")).distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a source cut at its budget."""
    mixed = mixing.mixed_texts(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins of permitted lengths."""
    return packing.pack(docs.select("doc_id", n_words(F.col("text")).alias("n_tokens"))).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", filter_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_near),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier is trained, which SQL can't express; the stages are tested against brute force.
ORACLE_SQL = None


@tidied
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        with tidy(keep=False):  # what a stage writes on its way goes when its rows are written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
