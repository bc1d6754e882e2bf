"""Joins of intervals inside a group, at a cost that follows the pairs that overlap and not all pairs of the group.

An outer interval is spelt out as the few dyadic blocks that tile it (two a level at most), an inner one by its start's
block at every level that an outer one can have; the one block of a tile that holds the start is where they meet, by
equality and once. Both sides are shuffled: what is spelt out is many times what the planner takes it for, so that a side
that looks small enough to be sent to every task need not be.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of intervals are below 2^31 in magnitude, shifted to be no less than 0.
_SHIFT = 1 << 31


def _tiles(low: Column, high: Column, top: Column) -> Column:
    """Blocks (level, n) that tile low to high, both included; none where low is above high. No block is above level top."""

    def at(level: Column) -> Column:
        width = F.pow(F.lit(2.0), level).cast("long")
        first, last = F.ceil(low / width).cast("long"), F.floor((high + 1) / width).cast("long") - 1
        some = first <= last
        left = F.when(some & (first % 2 == 1), F.struct(level.cast("int").alias("level"), first.alias("n")))
        right = F.when(some & (last % 2 == 0), F.struct(level.cast("int").alias("level"), last.alias("n")))
        return F.array(left, right)

    return F.array_distinct(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top), at))))


def _blocks(point: Column, top: Column) -> Column:
    """The block (level, n) of a point at each level from 0 to top."""
    return F.transform(F.sequence(F.lit(0), top), lambda level: F.struct(level.cast("int").alias("level"), F.floor(point / F.pow(F.lit(2.0), level)).cast("long").alias("n")))


def containing(inner: DataFrame, outer: DataFrame, group: str, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows as structs (inner, outer) of one group in which outer begins before inner and ends behind it; both bounds whole numbers. Rows with a null bound or group, or an end before their start, are in no pair."""
    shifted = lambda c: F.col(c).cast("long") + _SHIFT
    whole = lambda df, name: df.where(F.col(start) <= F.col(end)).select(F.col(group).alias("g"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), shifted(start).alias("s"), shifted(end).alias("e"))
    around = whole(outer, "outer")
    # no tile is longer than its interval, whose points are those from s + 1 to e
    top = max((around.agg(F.max(F.col("e") - F.col("s"))).first()[0] or 1).bit_length() - 1, 0)
    x = whole(inner, "inner").withColumn("block", F.explode(_blocks(F.col("s"), F.lit(top))))
    y = around.withColumn("block", F.explode(_tiles(F.col("s") + 1, F.col("e"), F.lit(top)))).select("g", "block.level", "block.n", "outer", F.col("e").alias("end_"))
    return x.select("g", "block.level", "block.n", "inner", "e").join(y.hint("merge"), ["g", "level", "n"]).where("end_ > e").select("inner", "outer")
