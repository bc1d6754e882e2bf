"""Operational analytics: status, percentiles, hot spots, alerts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles


def rough_percentiles(value: str, *at: float) -> list[Column]:
    """The same from sketches of fixed size, off by less than a ten-thousandth of the rows: they combine before the shuffle, whatever the group's size."""
    return [F.percentile_approx(value, p, 10_000).cast("double").alias(f"p{round(p * 100)}") for p in at]


def endpoint_stats(requests: DataFrame, least: int = 2, exact: bool = True) -> DataFrame:
    """Per endpoint: requests, mean and percentiles of latency, extremes, errors and their share; endpoints with fewer than ``least`` requests are left out.

    Exact percentiles are those of quantiles.grouped, whatever an endpoint's requests; without exact they come from sketches."""
    bad, at = F.col("status") >= 500, (0.5, 0.95, 0.99)
    others = [F.count("*").alias("n"), F.avg("latency").alias("mean"), F.min("latency").alias("lo"), F.max("latency").alias("hi"), F.count_if(bad).alias("errors")]
    g = quantiles.grouped(requests, ["endpoint"], "latency", at, *others) if exact else requests.groupBy("endpoint").agg(*others, *rough_percentiles("latency", *at))
    return g.where(F.col("n") >= least).withColumn("error_pct", F.try_divide(F.lit(100.0) * F.col("errors"), F.col("n")))


def slow_endpoints(requests: DataFrame, limit_ms: float) -> DataFrame:
    """Endpoints whose p95 exceeds the limit, with what that costs: n * (p95 - limit) / 1000."""
    s = endpoint_stats(requests).where(F.col("p95") > limit_ms)
    return s.select("endpoint", "n", "p95", (F.col("n") * (F.col("p95") - limit_ms) / 1000).alias("impact"))


def error_hotspots(requests: DataFrame) -> DataFrame:
    """Endpoints with errors: share of all errors, and mean latency of failures over groups, weighted by their sizes."""
    bad = requests.where("status >= 400")
    g = bad.groupBy("endpoint", "status").agg(F.count("*").alias("k"), F.avg("latency").alias("m"))
    e = g.groupBy("endpoint").agg(F.sum("k").alias("errors"), (F.sum(F.col("m") * F.col("k")) / F.sum("k")).alias("mean"))
    return e.crossJoin(F.broadcast(bad.agg(F.count("*").alias("__all")))).withColumn("share", F.lit(100.0) * F.col("errors") / F.col("__all")).drop("__all")


# Alert rules (type, limit, compare, severity), in percent or counts.
RULES = [
    ("cache_hit_rate_low", 70.0, "lt", "warning"),
    ("memory_high", 80.0, "gt", "critical"),
    ("slow_queries", 10.0, "gt", "warning"),
    ("evictions_high", 100.0, "gt", "warning"),
    ("error_rate_high", 5.0, "gt", "critical"),
    ("cpu_high", 90.0, "gt", "critical"),
    ("disk_high", 85.0, "gt", "critical"),
    ("connections_high", 80.0, "gt", "warning"),
]


def alerts(values: DataFrame, rules: DataFrame, recent: DataFrame) -> DataFrame:
    """New alerts (type, value, limit, severity): values (type, value) beyond a rule (type, limit, compare, severity), unless recent (type) has an open one."""
    over = ((F.col("compare") == "gt") & (F.col("value") > F.col("limit"))) | ((F.col("compare") == "lt") & (F.col("value") < F.col("limit")))
    return values.join(rules, "type").where(over).join(recent, "type", "left_anti").select("type", "value", "limit", "severity")


def open_alerts(stored: DataFrame, now: Column, hours: float = 1.0) -> DataFrame:
    """(type) of stored alerts (type, created_at, acknowledged) that suppress their like: not acknowledged and less than some hours old."""
    age = now.cast("double") - F.col("created_at").cast("timestamp").cast("double")
    return stored.where(~F.col("acknowledged") & (age < hours * 3600)).select("type").distinct()


def acknowledged(stored: DataFrame, which: Column, by: str, at: Column) -> DataFrame:
    """stored alerts (acknowledged, acknowledged_by, acknowledged_at, ...) of which those not yet acknowledged and meant by which are so now."""
    new = ~F.col("acknowledged") & which
    return stored.withColumns({"acknowledged_by": F.when(new, F.lit(by)).otherwise(F.col("acknowledged_by")), "acknowledged_at": F.when(new, at).otherwise(F.col("acknowledged_at")), "acknowledged": F.col("acknowledged") | which})


def changed_rules(rules: DataFrame, put: DataFrame | None = None, drop: list[str] | None = None, toggle: list[str] | None = None) -> DataFrame:
    """rules (type, limit, compare, severity, enabled) after changes: rows of put are new or take the place of their type's, dropped types go, toggled ones are switched."""
    if put is not None:
        rules = rules.join(put.select("type"), "type", "left_anti").select(*rules.columns).unionByName(put)
    return rules.where(~F.col("type").isin(*(drop or []))).withColumn("enabled", F.when(F.col("type").isin(*(toggle or [])), ~F.col("enabled")).otherwise(F.col("enabled")))


def status_of(critical: Column, warning: Column) -> Column:
    return F.when(critical > 0, "critical").when(warning > 5, "warning").otherwise("healthy")


def combined_hit_rate(l1: Column, l2: Column) -> Column:
    return l1 + (1 - l1) * l2


def complexity_band(complexity: Column) -> Column:
    return F.when(complexity <= 10, "green").when(complexity <= 20, "yellow").when(complexity <= 30, "orange").otherwise("red")


def hub_band(incoming_share: Column) -> Column:
    return F.when(incoming_share >= 0.7, "depended upon").when(incoming_share >= 0.3, "balanced").otherwise("depends")


def clamped(value: Column, lo: float, hi: float, base: float, span: float) -> Column:
    """base + span * value / hi, the value held between lo and hi."""
    return base + F.greatest(F.lit(lo), F.least(value, F.lit(hi))) / hi * span


def progress(done: Column, total: Column, seconds: Column) -> list[Column]:
    """(percent, eta): whole percent up to 100, and mean seconds an item times what is left."""
    pct = F.least(F.lit(100), F.floor(F.try_divide(done * 100, total))).cast("long")
    return [F.coalesce(pct, F.lit(0)).cast("long").alias("percent"), F.try_divide(seconds * (total - done), done).alias("eta")]


def storage(table: DataFrame) -> DataFrame:
    """One row about a stored table: n rows, files and bytes."""
    meta = table.metadataColumn("_metadata")
    files = table.select(meta["file_path"].alias("path"), meta["file_size"].alias("size")).groupBy("path").agg(F.max("size").alias("size"), F.count("*").alias("k"))
    return files.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
