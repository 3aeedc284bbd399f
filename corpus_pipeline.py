"""From raw documents to token ids: five stages, each over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Defined results, whatever the stage: a null text counts as the empty one, and rows with it are clean, equal to each other,
and have no tokens; null ids count as one id that is larger than all others for near copies and smaller for exact ones; of
rows that repeat an id and a text one stays; texts of any length are taken whole; a table without rows gives one without
rows; other columns, whatever their names, are kept up to the last stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate, exact_dedup, sentencepiece, simhash, toxicity
from lodestar.llm.common import materialise, remove, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage within edit distance of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of each document that is left."""
    return sentencepiece.encode(docs, sentencepiece.load())


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash", near_stage),
    ("decontaminate", benchmark_stage),
    ("sentencepiece", encode_stage),
]

#: SQL expresses neither the classifier nor the fingerprints nor the encoder; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. A stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            remove(spark, docs)
        docs = made
    return docs
