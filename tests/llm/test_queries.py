"""The registered queries: contract columns, SQL where there is any, and the pipeline's stages."""
from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lodeweave.llm import queries, sharding

COLUMNS = {
    "op1_lattice_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_jaccard": "doc_id n_shingles component_id",
    "op3_quality": "doc_id held_out score predicted",
    "op4_mix": "doc_id size source_size target taken",
    "op5_token_counts": "doc_id n_tokens n_tokens_after",
    "op6_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7_gif": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op8_toxicity": "doc_id held_out score predicted",
    "op9_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op11_vector_codes": "vec_id code error label_error codebooks_sha256",
    "op12_url_filter": "page_id host path rule verdict",
    "op13_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


def test_registered():
    assert set(COLUMNS) | {"pipeline"} == set(queries.queries()) and set(COLUMNS) < set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(queries.oracle_sql())))
def test_one_row_per_document(spark, sf_dir, name):
    out = queries.queries()[name](spark, sf_dir)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    rows = [dict(zip([d[0] for d in want.description], r, strict=True)) for r in want.fetchall()]
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == names
    assert sorted(str([r[n] for n in names]) for r in got.collect()) == sorted(str([r[n] for n in names]) for r in rows)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "n-gram Jaccard join" and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*columns, "shard", "slot"]
    rows = out.select("doc_id", "shard", "slot").collect()
    assert 0 < len(rows) <= 3 * before
    per = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in {r["shard"] for r in rows}}
    assert all(v == list(range(len(v))) for v in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1


def test_pipeline_keeps_clashing_columns_and_hot_rows(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").drop("n_chars")
    hot = spark.createDataFrame([(1000, "one and the same row of words again and again", "en", "hot")] * 150 + [(1001, "a row of its own that nobody else has", "en", "hot")], some.schema)
    extra = {"k": F.lit(1), "h": F.lit(2), "s": F.lit(3), "__row": F.lit(4), "row": F.lit(5), "slot": F.lit(6), "place": F.lit(7), "size": F.lit(8), "m": F.create_map(F.lit("a"), F.lit(1)), "score": F.lit(None).cast("string")}
    docs = some.unionByName(hot).withColumns(extra)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        if name == "sharding":
            assert out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
            places = {(r["shard"], r["slot"]) for r in rows}
            assert len(rows) == before == len(places)
        else:
            assert out.columns == docs.columns
            assert {tuple(r[c] for c in ("k", "h", "s", "__row", "row", "slot", "place", "size", "score")) for r in rows} <= {(1, 2, 3, 4, 5, 6, 7, 8, None)}
            assert all(r["m"] == {"a": 1} for r in rows)
        if name == "n-gram Jaccard join":
            assert sum(r["doc_id"] == 1000 for r in rows) == 1
    texts = docs.drop("shard")
    assert sharding.sharded(texts).count() == texts.count()


def test_pipeline_on_empty_and_null_rows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "some words here", "en", "s", 3), (2, "", "en", None, 0), (2, "", "en", None, 0)], schema)
    for some in (docs.limit(0), docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, some, sf_dir).count() <= 6
