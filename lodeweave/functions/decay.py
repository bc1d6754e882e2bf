"""Time decay, outcome factor and half-life of memories."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decay rate a day by tag, and for memories without such a tag.
RATES = {
    "sys:core": 0.001,
    "sys:anchor": 0.001,
    "sys:pattern": 0.005,
    "sys:protocol": 0.002,
    "sys:extension": 0.01,
    "sys:project": 0.01,
    "sys:user:profile": 0.005,
    "sys:history": 0.05,
    "sys:drift": 0.02,
    "sys:trace": 0.08,
    "ephemeral": 0.1,
}
DEFAULT_RATE = 0.01


def age_days(now: Column, created: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / F.lit(86_400_000_000.0)


def decay(age: Column, rate: Column | float = DEFAULT_RATE) -> Column:
    """exp(-rate * age); 1 for a negative age or a rate of 0 or less."""
    rate = F.lit(rate) if isinstance(rate, float) else rate
    return F.when((age < 0) | (rate <= 0), F.lit(1.0)).otherwise(F.exp(-rate * age))


def rate_of_tags(tags: Column) -> Column:
    """The rate of the first tag that has one."""
    known = F.create_map(*[F.lit(x) for pair in RATES.items() for x in pair])
    first = F.get(F.filter(tags, lambda t: F.array_contains(F.map_keys(known), t)), F.lit(0))
    return F.coalesce(F.try_element_at(known, first), F.lit(DEFAULT_RATE))


def outcome_factor(positive: Column, negative: Column) -> Column:
    return F.when((positive == 0) & (negative == 0), F.lit(1.0)).otherwise(F.lit(1.0) + F.lit(0.5) * (positive - negative) / (positive + negative + 1))


def half_life(rate: Column) -> Column:
    return F.when(rate <= 0, F.lit(float("inf"))).otherwise(F.lit(0.6931471805599453) / rate)
