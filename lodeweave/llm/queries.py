"""One query for each training-data operator, over its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, gifmedia, jaccard, lmscore, merkle, mixing, quality, secretscan, sharding, sql, tokencount, toxicity, urlfilter, vectorcodes
from ._common import table


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scored(table(spark, sf_dir, "documents"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counted(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secrets(table(spark, sf_dir, "documents"))


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gifmedia.media_columns(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_listing(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(table(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.lowered_where_fifth(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_lattice_lm, op2_jaccard, op3_quality, op4_mix, op5_token_counts, op6_secrets, op7_gif, op8_toxicity, op9_shards, op10_decontaminate, op11_vector_codes, op12_url_filter, op13_merkle, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard": sql.OP2, "op6_secrets": sql.OP6, "op10_decontaminate": sql.OP10, "op11_vector_codes": sql.OP11, "op12_url_filter": sql.OP12, "op13_merkle": sql.OP13}
