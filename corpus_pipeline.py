"""A training-data pipeline: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackwell.llm import decontamination, line_dedup, mixing, quality_rules, similarity
from trackwell.llm.common import Scratch, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail or lose too much."""
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of several lines stay where they come first."""
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: SimHash fingerprints within 3 bits, or five-word shingles of similarity 0.8 or more."""
    return similarity.keep_one_by_both(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by source weights: one row for each draw, with its shard, its place there and its pass."""
    return mixing.mixture(docs)


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("similarity", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mix),
]

#: XXH64 of shingles and edit distances within bands are beyond SQL; the tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written to the shared scratch folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if n + 1 == len(STAGES):
            return done
        done = scratch.save(done)
        if n:
            scratch.drop(docs)
        docs = done
