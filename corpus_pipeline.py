"""The corpus pipeline: documents -> quality -> near duplicates -> decontamination -> training mix.

Each stage works on all that its predecessor kept. The first three return the columns of documents; the last returns a
row for each use of a document, with `use`, `words` and `position` beside those columns, in training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findloom.llm import decontam, mixing, quality, simhash
from findloom.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling (operator 7): the draw by both models' ratios and the filter's weights, of as many documents as the filter selects."""
    return quality.drawn(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more stays (operator 8)."""
    return simhash.kept(docs, n=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go (operator 5)."""
    return decontam.without_passages(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix of what is left (operator 1)."""
    return mixing.training_rows(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: SQL cannot express near-duplicate groups or edit distances in texts; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
