"""The corpus pipeline: documents in, encoded documents out, one Parquet table between stages.

All stages but the last return the columns of ``documents``; ``n_chars`` follows
the text where a stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import byte_bpe, decontaminate, line_dedup, near_dups, toxicity
from shelfscope.llm.base import documents, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def civil(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    return toxicity.without_toxic(docs, labels)


def lines_once(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Chunks of lines that stood in an earlier document are cut out; every document stays."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dups.without_near_duplicates(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_benchmarks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every text that is left, the character each token begins in, and the bytes the ids decode to."""
    return byte_bpe.encode(docs, back=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", civil),
    ("line_dedup", lines_once),
    ("near_dups", one_of_each),
    ("decontaminate", clean_of_benchmarks),
    ("byte_bpe", encoded),
]

#: The classifier and the merges of the encoder are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before wrote."""
    docs = documents(spark, folder)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, folder))
    return docs
