"""Distances and similarities of ARRAY<FLOAT> vectors, in double precision; NULL for a zero norm."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


# The three meanings that a "similarity" has, each with a name of its own.
def similarity_half(distance: Column) -> Column:
    """1 - d / 2, over cosine distances: 0 to 1."""
    return F.lit(1.0) - distance / 2


def similarity_complement(distance: Column) -> Column:
    """1 - d, the cosine itself."""
    return F.lit(1.0) - distance


def _unit(x: Column) -> Column:
    """x held between 0 and 1, NULL as 0 (greatest and least pass over NULLs)."""
    return F.when(x.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def clipped(cos: Column) -> Column:
    return _unit(cos)


def rescaled(cos: Column) -> Column:
    return _unit((cos + 1) / 2)
