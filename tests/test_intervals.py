"""Interval joins against comparing all pairs."""
from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodeweave.operators.intervals import containing


def test_containing_equals_all_pairs_and_makes_few(spark):
    pick = random.Random(3)
    rows = [(i, "fg"[i % 5 == 0], a := pick.randint(-40, 400), a + pick.choice([-2, 0, 1, 5, 30, 200])) for i in range(260)]
    rows += [(900, None, 1, 9), (901, "f", None, 9), (902, "f", 3, None), (903, "f", -(1 << 31), (1 << 31) - 2), (904, "f", (1 << 31) - 4, (1 << 31) - 3)]
    df = spark.createDataFrame(rows, "id long, f string, a long, b long")
    want = {(c[0], p[0]) for c in rows for p in rows if None not in (c[1], c[2], c[3], p[1], p[2], p[3]) and c[1] == p[1] and c[2] <= c[3] and p[2] < c[2] and p[3] > c[3]}
    got = [(r["c"], r["p"]) for r in containing(df, df, "f", "a", "b").select(F.col("inner.id").alias("c"), F.col("outer.id").alias("p")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # a file of very many units that stand one behind another: no pairs are made
    units = spark.range(60_000).select(F.lit("big").alias("f"), "id", (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 8).alias("b"))
    assert containing(units, units, "f", "a", "b").count() == 0


def test_what_is_spelt_out_is_not_sent_to_every_task(spark):
    df = spark.range(2000).select(F.lit("f").alias("f"), "id", (F.col("id") * 7 % 97).alias("a"), (F.col("id") * 7 % 97 + F.col("id") % 13).alias("b"))
    found = containing(df, df.where("id % 3 = 0"), "f", "a", "b")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # neither side is spelt out at levels that no interval here reaches
    assert found.count() == df.alias("c").join(df.where("id % 3 = 0").alias("p"), F.expr("p.a < c.a AND p.b > c.b")).count()
