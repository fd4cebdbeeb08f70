"""A corpus pipeline of five stages over ``documents``; each takes all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm import bpe, exact_dedup, mixing, near_dedup, quality
from corvid.llm.shared import written

#: Good and poor documents keep all of their tokens, toxic ones should have none.
TARGETS = {"good": 1.0, "poor": 1.0, "toxic": 0.0}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, that with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, that with the smallest id stays."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with the chance of their rate, which is 1 for those surely not toxic."""
    return mixing.thin(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), targets=TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the ids of each document and of its decoded text."""
    return bpe.bpe(docs, digests=True)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mix), ("BPE", encode)]

#: Suffix arrays, near copies, fitted rates and BPE are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
