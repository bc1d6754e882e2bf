"""The stored trigram index against similarities found text by text."""
from __future__ import annotations

import os
import random
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import text as X
from lodeweave.operators import hybrid, trigram
from lodeweave.operators import search as S
from lodeweave.operators.trigram import TrigramIndex

ODD = ["", None, "a", "ab cd", "  The THE the ", "İstanbul ΣΑΣ ß ŉ", "日本語 テキスト 日本", "x" * 5000, "naïve café_déjà-vu", "1234 ½ ² ٣", "été", "a\tb\nc\r\nd\0e", "\U0001d4d0\U0001d4d1 z", "the that of", "that of and in the tion"]


def texts(n, seed=1):
    pick = random.Random(seed)
    words = ["the", "that", "of", "and", "in", "tion", "station", "Hand", "lorem", "été", "x1", "q"] + ["w" + str(i) for i in range(60)]
    return [" ".join(pick.choice(words) for _ in range(pick.choice((1, 3, 8, 40)))) for _ in range(n)]


def write(spark, path, rows, kind="long"):
    spark.createDataFrame(rows, f"id {kind}, title string, body string").coalesce(1).write.mode("append").parquet(path)


def index_of(spark, path, base):
    return TrigramIndex(spark, path, "id", {"title": F.col("title"), "body": F.col("body")}, str(base))


def brute(spark, path, field, query):
    t = spark.read.parquet(path)
    return {r["id"]: r["s"] or 0.0 for r in t.select("id", X.trgm_similarity(F.coalesce(F.col(field), F.lit("")), F.lit(query)).alias("s")).collect()}


def same(index, spark, path, query):
    for field in ("title", "body"):
        want = brute(spark, path, field, query)
        got = index.similarities(field, query).collect()
        assert len(got) == len(want) and {r["id"]: r["sim"] for r in got} == pytest.approx(want)
        for least in (0.05, 0.3, 0.5, 1.0):
            near = {r["id"]: r["sim"] for r in index.alike(field, query, least).collect()}
            assert near == pytest.approx({k: v for k, v in want.items() if v >= least})
            assert len(near) <= index.candidates(field, query, least) <= len(want)


def test_index_equals_similarities(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "some chunks+1")
    rows = [(i, t, b) for i, (t, b) in enumerate(zip(ODD + texts(150), ODD[::-1] + texts(150, 2), strict=True))]
    write(spark, path, rows)
    index = index_of(spark, path, tmp_path / "ix").refresh()
    for query in ("The that of and in the tion", "日本語", "İstanbul", "", "½ x", "\U0001d4d0\U0001d4d1"):
        same(index, spark, path, query)
    with pytest.raises(ValueError):
        index.alike("body", "x", 0.0)


def test_index_follows_the_files(spark, tmp_path):
    path, base = str(tmp_path / "t"), tmp_path / "ix"
    write(spark, path, [(i, t, t[::-1]) for i, t in enumerate(texts(40))])
    index = index_of(spark, path, base).refresh()
    assert index.known == index_of(spark, path, base).refresh().known and len(index.known) == 1
    first = next(f for f in os.listdir(path) if f.endswith(".parquet"))
    write(spark, path, [(100 + i, t, t) for i, t in enumerate(texts(30, 3))])
    index = index_of(spark, path, base).refresh()
    assert len(index.known) == 2
    assert spark.read.parquet(f"{index.base}/{index.known[1]}/rows").agg(F.count_distinct("file")).first()[0] == 1  # only the new file was read
    same(index, spark, path, "the that of tion")
    os.remove(f"{path}/{first}")
    index = index_of(spark, path, base).refresh()
    assert len(index.known) == 2 and index.similarities("title", "x").count() == 30
    same(index, spark, path, "the that of tion")
    os.makedirs(base / "kaputt" / "rows")  # a generation that was never finished counts for nothing
    shutil.copytree(path, tmp_path / "u")
    assert index_of(spark, path, base).refresh().similarities("body", "the").count() == 30


def test_small_segments_text_ids_and_no_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    write(spark, path, [(f"k{i}", t, t) for i, t in enumerate(texts(90))] + [(None, "the", "the")], "string")
    import pyarrow as pa

    schema = pa.schema([("file", pa.string()), ("segment", pa.string()), ("field", pa.int32()), ("gram", pa.int64()), ("rows", pa.binary()), ("ids", pa.list_(pa.string()))])
    few = texts(300)
    monkeypatch.setattr(trigram, "_ROOM", 30**3 * 70)  # so that segments have to be halved
    made = list(trigram._segment("f", 0, "s", pa.array([str(i) for i in range(300)]), few, schema))
    assert len(made) > 1 and sum(len(b["ids"][0]) for b in made) == 300
    monkeypatch.undo()
    same(index_of(spark, path, tmp_path / "ix").refresh(), spark, path, "the that of tion")
    none = str(tmp_path / "none")
    write(spark, none, [])
    assert index_of(spark, none, tmp_path / "ix").refresh().alike("body", "the", 0.3).collect() == []


def test_searches_with_and_without_the_index_agree(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [(i, f"name{i % 9}", t, f"pkg.name{i % 9}", "python" if i % 2 else "go") for i, t in enumerate(texts(120))]
    spark.createDataFrame(rows, "id long, name string, source_code string, name_path string, language string").repartition(2).write.parquet(path)
    chunks = spark.read.parquet(path)
    index = TrigramIndex(spark, path, "id", {c: F.col(c) for c in ("name", "source_code", "name_path")}, str(tmp_path / "ix")).refresh()
    for query, filters in (("the that of", None), ("pkg.name3", {"language": "go"})):
        plain, quick = ([(r["id"], r["rank"]) for r in hybrid.search_code(chunks, query, filters=filters, threshold=0.1, index=i).collect()] for i in (None, index))
        assert plain == quick and plain
    memories = chunks.select("id", F.col("name").alias("title"), F.col("source_code").alias("embedding_source"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(datetime(2024, 1, 1)).alias("created_at"))
    index = TrigramIndex(spark, path, "id", {"title": F.col("name"), "embedding_source": F.col("source_code")}, str(tmp_path / "ix")).refresh()
    plain, quick = ([(r["id"], r["rank"]) for r in hybrid.search_memories(memories, "station", datetime(2024, 2, 1), index=i).collect()] for i in (None, index))
    assert plain == quick and plain
    assert S.TRIGRAM_LIMIT == 0.3
