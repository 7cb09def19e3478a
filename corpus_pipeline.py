"""From raw documents to token ids: five stages, each on what the one before kept.

1. ``quality``: documents that the neighbours of labelled ones reject go (null labels teach nothing).
2. ``near_copies``: of each group that similarity links join, the row of smallest id stays.
3. ``secrets``: spans of secrets are masked in the text.
4. ``mix``: the words that the mix of sources takes stay, repeated ones in a row of their own.
5. ``encode``: token ids of each text, and whether they decode to it.

A null id counts as greater than all others; a null text as empty. Rows without words are nobody's
copies, and the mix takes nothing of them. Columns beyond the known ones are kept through stage 4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwright.llm import bpe_transducer, mixture, ngram_join, quality_knn, secret_scan
from cartwright.llm.queries import (
    QUALITY_THRESHOLD,
    splitting_pattern,
    table,
    vocabulary,
)
from cartwright.llm.words import remainder, unused, whole_text
from cartwright.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps; it learns from the labels that aren't held out."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    model = quality_knn.fit(docs, labels)
    (score,) = unused(docs, "score")
    scored = docs.withColumn(score, quality_knn.score(model, "text"))
    return scored.where(F.col(score) >= QUALITY_THRESHOLD).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id."""
    return ngram_join.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked and the number of characters brought up to date."""
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document has a row for each pass that takes words of it."""
    mixed = mixture.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids, exact`` of each row."""
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    trip = bpe_transducer.round_trip("text", ranks, splitting_pattern())
    read = docs.select("doc_id", "source", whole_text("text").alias("text"))
    return read.withColumn("trip", trip).select(
        "doc_id",
        "source",
        F.size("trip.ids").cast("long").alias("n_tokens"),
        F.col("trip.ids").alias("ids"),
        (F.col("trip.decoded") == F.col("text")).alias("exact"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mix", mix),
    ("encode", encode),
]

#: A trained classifier and pseudo-random draws are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
