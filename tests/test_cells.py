"""Nearest neighbours over stored cells against all distances."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.operators import search
from lodeweave.operators.cells import CellIndex, spread

SCHEMA = "id long, v array<float>"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(path)


def clustered(n, seed=0, groups=12, dim=8):
    pick = np.random.default_rng(seed)
    middle = np.random.default_rng(99).normal(0, 10, (groups, dim))
    return [[float(x) for x in np.float32(middle[i % groups] + pick.normal(0, 0.3, dim))] for i in range(n)]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_cells_equal_all_distances_and_touch_few(spark, tmp_path, metric):
    path = str(tmp_path / "v")
    rows = list(enumerate(clustered(900)))
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # copies
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [2 * x for x in rows[7][1]])]
    write(spark, path, rows)
    df = spark.read.parquet(path)
    sound = df.where("v is not null and not exists(v, x -> x is null or isnan(x))" + (" and exists(v, x -> x <> 0)" if metric == "cosine" else ""))
    queries = sound.where("id % 50 = 0 or id in (3, 2004)").select(F.col("id").alias("query_id"), F.col("v").alias("query")).unionByName(spark.createDataFrame([(-1, None), (-2, [9.0] * 8)], "query_id long, query array<float>"))
    index = CellIndex(spark, path, "id", "v", metric, pivots=12, base=str(tmp_path / "ix")).refresh()
    for k in (1, 7, 60):
        want = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in search.knn(sound, "v", queries, k, "id", metric).collect()}
        got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in index.nearest(queries, k).collect()}
        assert set(got) == set(want)
        for at, (key, d) in want.items():
            assert got[at] == (key, pytest.approx(d, abs=1e-9))
    looked, of = index.touched(queries.where("query_id >= 0"), 7)
    assert 0 < looked < 0.35 * of


def test_cells_of_new_files_few_rows_and_none(spark, tmp_path):
    path, base = str(tmp_path / "v"), str(tmp_path / "ix")
    write(spark, path, list(enumerate(clustered(30))))
    assert CellIndex(spark, path, "id", "v", "l2", pivots=5, base=base).refresh().known
    write(spark, path, [(100 + i, v) for i, v in enumerate(clustered(50, 4))])
    index = CellIndex(spark, path, "id", "v", "l2", pivots=5, base=base).refresh()
    df = spark.read.parquet(path)
    queries = df.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    for k in (3, 200):  # also more than there are
        want = sorted((r["query_id"], r["rank"], r["id"]) for r in search.knn(df, "v", queries, k, "id", "l2").collect())
        assert sorted((r["query_id"], r["rank"], r["id"]) for r in index.nearest(queries, k).collect()) == want
    assert index.nearest(queries.limit(0), 3).count() == 0
    none = str(tmp_path / "none")
    write(spark, none, [(1, None)])
    assert CellIndex(spark, none, "id", "v", base=base).refresh().nearest(queries, 3).count() == 0


def test_pivots_are_spread_and_distinct():
    x = np.array(clustered(200))
    p = spread(x, 12)
    assert len(np.unique(p, axis=0)) == 12 and len(spread(np.ones((5, 3)), 4)) == 1 and len(spread(np.zeros((0, 3)), 4)) == 0
