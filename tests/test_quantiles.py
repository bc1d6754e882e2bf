"""Percentiles of large groups, and the best share of a table, without a task that holds them."""
from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.operators import quantiles

AT = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)


def values():
    pick = random.Random(3)
    rows = [("a", pick.gauss(0, 1)) for _ in range(4000)]
    rows += [("b", float(pick.choice([1, 2]))) for _ in range(900)]  # two values, the median between them
    rows += [("c", 7.0)] * 500 + [("c", pick.random() * 1e-9) for _ in range(260)] + [("c", 1e300 * pick.random()) for _ in range(250)]
    rows += [("d", 1.0), ("d", 2.0), (None, 5.0), (None, None), ("e", None)] + [(None, float(i)) for i in range(300)]
    return rows


def expected(rows):
    groups = {}
    for k, v in rows:
        groups.setdefault(k, [])
        if v is not None:
            groups[k].append(v)
    return {k: [float(np.percentile(v, 100 * p)) if v else None for p in AT] for k, v in groups.items()}


@pytest.mark.parametrize("most, grid", [(1 << 20, 1000), (100, 50), (20, 10)])
def test_percentiles_of_groups(spark, most, grid):
    rows = values()
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = quantiles.grouped(df, ["k"], "v", AT, F.count("*").alias("rows"), most=most, grid=grid).collect()
    want = expected(rows)
    assert {r["k"] for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert r["rows"] == sum(k == r["k"] for k, _ in rows)
        assert [r[f"p{round(p * 100)}"] for p in AT] == (want[r["k"]] if want[r["k"]][0] is None else pytest.approx(want[r["k"]], rel=1e-9))


def test_percentiles_of_one_group_and_of_none(spark):
    df = spark.createDataFrame([(float(i * i),) for i in range(501)], "v double")
    for most in (10, 1 << 20):
        r = quantiles.grouped(df, [], "v", (0.5, 0.99), F.max("v").alias("top"), most=most, grid=20).collect()
        assert [tuple(x) for x in r] == [pytest.approx((250000.0, 62500.0, 495.0**2))] or tuple(r[0]) == pytest.approx((250000.0, 62500.0, 495.0**2))
    assert [tuple(x) for x in quantiles.grouped(df.limit(0), [], "v", (0.5,)).collect()] == [(None,)]
    assert quantiles.grouped(df.limit(0).withColumn("k", F.lit(1)), ["k"], "v", (0.5,)).collect() == []


@pytest.mark.parametrize("most, grid", [(1 << 20, 1000), (10, 8)])
def test_best_share(spark, most, grid):
    pick = random.Random(5)
    rows = [(i, round(pick.random(), 1) if i % 3 else 0.5) for i in range(700)] + [(9000, None)]
    df = spark.createDataFrame(rows, "k long, s double").repartition(4)
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))
    for percent in (0, 0.1, 30, 47.5, 100):
        got = quantiles.best(df, "s", "k", percent, most, grid)
        assert "TakeOrdered" not in got._jdf.queryExecution().toString() and "CollectLimit" not in got._jdf.queryExecution().toString() or percent == 0
        assert sorted((r["k"], r["s"]) for r in got.collect()) == sorted(order[: -int(-700 * percent // 100)])
    assert quantiles.best(df.limit(0), "s", "k", 30).collect() == []
