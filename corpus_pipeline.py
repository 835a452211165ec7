"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, each stage written and reread.

Each stage works on all rows that the one before it kept. Empty input passes through every stage. The quality rules
reject null and empty texts; null ids, languages and sources are values like others, and rows that repeat an id and its
text leave near-dedup as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import table, written
from glossa.llm.line_dedup import line_dedup
from glossa.llm.minhash import near_dedup
from glossa.llm.mixing import mix
from glossa.llm.quality_rules import quality_filter
from glossa.llm.queries import DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, domain_of, pieces_by_domain

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; n_chars follows the text."""
    return line_dedup(docs, count_col=None).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 5-word shingles, similarity of 0.8 or more."""
    return near_dedup(docs, shingle=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, four fifths of all tokens; a document may be drawn twice."""
    drawn = mix(docs, domain_of(F.col("source")), DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, share=(4, 5), max_epochs=2)
    return drawn.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, the domains in their target proportions."""
    return pieces_by_domain(docs)


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: SQL has neither the band keys nor the tokenizer; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
