"""Training-corpus pipeline: quality, near duplicates, decontamination, mixture, shards.

It belongs to the operators of lodeweave.llm and cannot be imported without
them. Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns
of documents, the last one with shard and slot besides; run() writes every
stage's result as Parquet in the shared folder and gives it to the next.

Every stage takes docs with nulls in any column, empty and very long texts, rows
that repeat, no rows at all, and further columns of any name, which it hands on
(columns named shard and slot are replaced by the last stage).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeweave.llm import decontam, jaccard, mixing, quality, sharding
from lodeweave.llm._common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored as zeros; without labels nothing goes."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the smallest doc_id stays, and of rows that share a doc_id the smallest. Rows without doc_id or words are nobody's copies."""
    return jaccard.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts and an empty benchmark hold none."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it; null sources are one source, texts without words are not taken."""
    return mixing.mixed(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard and their place in it; rows that repeat have a place each."""
    return sharding.sharded(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing to target weights", mix_stage),
    ("sharding", shard_stage),
]

#: A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), "stage", replace=True)
    return docs
