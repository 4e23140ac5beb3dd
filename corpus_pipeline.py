"""From raw documents to a training mixture: five stages, each one operator over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``. Null texts count as empty everywhere; a table
without rows gives one without rows; a null id or source is carried along. Every stage decides by text and labels, so
repeated rows are treated alike until the near-duplicate stage leaves one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm import leaks, lines, mixing, neardup, quality
from segmentry.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accept(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; every document stays."""
    cleaned = lines.drop_boilerplate(docs.select(*COLUMNS))
    length = F.when(F.col("__removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", length).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return neardup.keep_one(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return leaks.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents with the pass and the block of the mixture they belong to; every document at least once."""
    mixed = mixing.mix(docs.select(*COLUMNS), key=["doc_id", "n_chars"])
    return mixed.select(*COLUMNS, F.col("__epoch").alias("epoch"), F.col("__mix_block").alias("mix_block"), F.col("__tokens").alias("n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

# The classifier and the search for an exponent have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
