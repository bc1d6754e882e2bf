"""Event-time windows; the same builders serve batch and streaming frames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    return _timed(events, late).groupBy(F.window("ts", size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return _timed(events, late).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    return _timed(events, late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), key, "n")


def _timed(events: DataFrame, late: str) -> DataFrame:
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return x.withWatermark("ts", late) if events.isStreaming else x


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """One row per key; in a stream the memory of keys ends with the watermark."""
    x = _timed(events, late)
    return x.dropDuplicatesWithinWatermark([key]) if events.isStreaming else x.dropDuplicates([key])
