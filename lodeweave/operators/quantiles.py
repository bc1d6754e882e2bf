"""Exact percentiles of groups of any size.

A group of at most ``most`` values is left to one aggregate. The values of a larger one never meet in a task: a sketch of
fixed size, which combines before the shuffle, gives for each wanted rank an interval that holds it; one pass counts what
lies below and inside; and only an interval of few distinct values is sorted, its equal values counted together. An
interval of too many is narrowed again, to some thousandths of its rows each time.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, dropped

#: Values of a group, and distinct values of an interval, up to which one task may hold them.
MOST = 1 << 20
#: Places of a sketch that are read, and its accuracy; the sketch is off by a tenth of a place at most.
GRID, ACCURACY = 1000, 10_000
#: Rows of a table up to which it is broadcast to a join; a larger one is shuffled.
FEW = 1 << 16


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def selected(rows: DataFrame, wanted: DataFrame, most: int = MOST, grid: int = GRID, turn: int = 0) -> DataFrame:
    """(g, k, v): the value of rank k, from 0, of each group, for rows (g, v) and wanted (g, k, n), n the group's values; g is a struct."""
    if turn > 40:
        raise RuntimeError("intervals do not get narrower")
    wanted = cut(wanted.distinct())
    places = [i / grid for i in range(grid + 1)]
    sketch = rows.groupBy("g").agg(F.percentile_approx("v", places, max(ACCURACY, 10 * grid)).alias("at"))
    place = F.col("k") / F.greatest(F.lit(1), F.col("n") - 1) * grid
    low, high = F.floor(place).cast("int") - 1, F.ceil(place).cast("int") + 1
    bounds = wanted.join(sketch, "g").select("g", "k", F.when(low >= 0, F.get("at", low)).alias("low"), F.when(high <= grid, F.get("at", high)).alias("high"))
    # beyond the first and the last place an interval is open
    bounds = cut(bounds)
    inside = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))
    # bounds are counted apart from what lies between them: a value of very many rows is a bound, and does not come along
    counts = rows.join(_few(bounds), "g").groupBy("g", "k").agg(
        F.first("low").alias("low"), F.first("high").alias("high"), F.count_if(F.col("v") < F.col("low")).alias("below"), F.count_if(F.col("v") == F.col("low")).alias("at_low"),
        F.count_if(inside).alias("inside"), F.count_if(F.col("v") <= F.col("high")).alias("upto"), F.approx_count_distinct(F.when(inside, F.col("v"))).alias("kinds"),
    )
    counts = cut(counts.withColumn("first", F.col("below") + F.col("at_low")))
    if not counts.where((F.col("below") > F.col("k")) | (F.col("high").isNotNull() & (F.col("upto") <= F.col("k")))).isEmpty():
        raise RuntimeError("a sketch was off by more than its bound")
    found = counts.where(F.col("k") < F.col("first")).select("g", "k", F.col("low").alias("v"))
    found = found.unionByName(counts.where(F.col("k") >= F.col("first") + F.col("inside")).select("g", "k", F.col("high").alias("v")))
    between = counts.where((F.col("k") >= F.col("first")) & (F.col("k") < F.col("first") + F.col("inside")))
    small, large = between.where(F.col("kinds") <= most), between.where(F.col("kinds") > most)
    if not small.isEmpty():
        each = rows.join(_few(small.select("g", "k", "low", "high", "first")), "g").where(inside).groupBy("g", "k", "v").agg(F.count("*").alias("times"), F.first("first").alias("first"))
        upto = F.sum("times").over(Window.partitionBy("g", "k").orderBy("v")) + F.col("first")
        found = found.unionByName(each.withColumn("upto", upto).where(F.col("upto") > F.col("k")).groupBy("g", "k").agg(F.min("v").alias("v")))
    if not large.isEmpty():
        pair = F.struct("g", "k")
        again = cut(rows.join(_few(large.select("g", "k", "low", "high")), "g").where(inside).select(pair.alias("g"), "v"))
        deeper = selected(again, large.select(pair.alias("g"), (F.col("k") - F.col("first")).alias("k"), F.col("inside").alias("n")), most, grid, turn + 1)
        found = found.unionByName(deeper.select("g.g", "g.k", "v"))
    found = cut(found)
    dropped(wanted, bounds, counts)
    return found


def _name(p: float) -> str:
    return f"p{round(p * 100)}"


def grouped(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...], *others: Column, most: int = MOST, grid: int = GRID) -> DataFrame:
    """df grouped by keys (none: one group, even of no rows): others, aggregates, and the continuous percentiles of value as p50 and so on. Null values do not count."""
    plain = [F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY `{value}`)").alias(_name(p)) for p in at]
    sizes = df.groupBy(*keys).agg(F.count(value).alias("n"))
    heavy = cut(sizes.where(F.col("n") > most).select(F.struct(*keys, F.lit(0).alias("_")).alias("g"), "n"))
    if heavy.isEmpty():
        dropped(heavy)
        return df.groupBy(*keys).agg(*others, *plain)
    some = df.withColumn("g", F.struct(*keys, F.lit(0).alias("_")))
    light = some.join(_few(heavy), "g", "left_anti").groupBy(*keys).agg(*others, *plain)
    if not keys:
        light = light.limit(0)
    rows = some.join(_few(heavy.select("g")), "g", "left_semi")
    spots = F.array(*[F.struct(F.lit(_name(p)).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("pos")) for p in at])
    wanted = heavy.select("g", "n", F.explode(spots).alias("w")).select("g", "n", "w.*")
    low, high = F.floor("pos").cast("long"), F.ceil("pos").cast("long")
    ranks = wanted.select("g", "n", low.alias("k")).unionByName(wanted.select("g", "n", high.alias("k")))
    known = selected(rows.select("g", F.col(f"`{value}`").cast("double").alias("v")).where("v IS NOT NULL"), ranks, most, grid)
    x, y = known.select("g", F.col("k").alias("lo"), F.col("v").alias("a")), known.select("g", F.col("k").alias("hi"), F.col("v").alias("b"))
    both = wanted.select("g", "name", "pos", low.alias("lo"), high.alias("hi")).join(x, ["g", "lo"]).join(y, ["g", "hi"])
    part = F.col("pos") - F.col("lo")
    told = both.groupBy("g").agg(*[F.max(F.when(F.col("name") == _name(p), F.col("a") * (1 - part) + F.col("b") * part)).alias(_name(p)) for p in at])
    whole = rows.groupBy("g").agg(*others) if others else rows.select("g").distinct()
    out = whole.join(told, "g").select(*[F.col("g")[k].alias(k) for k in keys], *[F.col(c) for c in whole.columns if c != "g"], *map(_name, at))
    return light.unionByName(out)


def best(df: DataFrame, score: str, key: str, percent: float, most: int = MOST, grid: int = GRID) -> DataFrame:
    """The best percent of the rows (rounded up) by score, of equal scores those of smallest key; rows equal in both stand or fall together. Rows without a score are none.

    The score and the key of the last row are found as order statistics, so no task holds the rows that stay."""
    df = df.where(F.col(score).isNotNull())
    n = df.count()
    k = min(n, math.ceil(n * percent / 100))
    if k <= 0:
        return df.limit(0)
    last = _value(df.select(F.col(score).alias("v")), n - k, n, most, grid)
    counts = df.agg(F.count_if(F.col(score) > last).alias("above"), F.count_if(F.col(score) == last).alias("ties")).first()
    if counts["above"] + counts["ties"] == k:
        return df.where(F.col(score) >= last)
    edge = _value(df.where(F.col(score) == last).select(F.col(key).alias("v")), k - counts["above"] - 1, counts["ties"], most, grid)
    return df.where((F.col(score) > last) | ((F.col(score) == last) & (F.col(key) <= edge)))


def _value(rows: DataFrame, k: int, n: int, most: int, grid: int):
    one = F.struct(F.lit(0).alias("_")).alias("g")
    wanted = rows.sparkSession.range(1).select(one, F.lit(k).cast("long").alias("k"), F.lit(n).cast("long").alias("n"))
    return selected(rows.select(one, "v"), wanted, most, grid).first()["v"]
