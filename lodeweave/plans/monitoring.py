"""Operational analytics over events as requests."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import text as X
from ..operators import monitoring as M
from ..operators import quantiles
from ..sources.tables import EDGES_SQL, MEMORIES_SQL, REQUESTS_SQL, edges, load, memories, requests
from .filters import now_of

R = f"WITH {REQUESTS_SQL}"


def r(c, n=6):
    return F.round(c, n)


@register("m1_status", "SELECT count(*) FILTER (WHERE event_type = 'error') AS critical, count(*) FILTER (WHERE event_type = 'click') AS warning, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'critical' WHEN count(*) FILTER (WHERE event_type = 'click') > 5 THEN 'warning' ELSE 'healthy' END AS status FROM events")
def m1(spark, sf):
    x = load(spark, sf, "events").agg(F.count_if(F.col("event_type") == "error").alias("critical"), F.count_if(F.col("event_type") == "click").alias("warning"))
    return x.withColumn("status", M.status_of(F.col("critical"), F.col("warning")))


@register("m2_critical_with_age", "SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' ELSE (s // 3600) || 'h ago' END AS age FROM (SELECT event_id, ts, date_diff('second', date_trunc('second', ts), date_trunc('second', (SELECT max(ts) FROM events))) AS s FROM events WHERE event_type = 'error') ORDER BY ts DESC, event_id LIMIT 20")
def m2(spark, sf):
    e = load(spark, sf, "events")
    s = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    top = e.where("event_type = 'error'").orderBy(F.col("ts").desc(), "event_id").limit(20)
    return top.crossJoin(now_of(e)).select("event_id", X.age_text(s).alias("age"))


@register("m3_timeline", "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def m3(spark, sf):
    return load(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket"), "event_type").agg(F.count("*").alias("n"))


@register("m4_distribution", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def m4(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(10)


_STATS = "SELECT endpoint, count(*) AS n, round(avg(latency), 6) AS mean, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, round(quantile_cont(latency, 0.99), 6) AS p99, min(latency) AS lo, max(latency) AS hi, count(*) FILTER (WHERE status >= 500) AS errors, round(100.0 * count(*) FILTER (WHERE status >= 500) / count(*), 6) AS error_pct FROM requests GROUP BY endpoint HAVING count(*) >= 2"


@register("m5_endpoint_stats", f"{R} {_STATS}")
def m5(spark, sf):
    s = M.endpoint_stats(requests(spark, sf))
    return s.select("endpoint", "n", *[r(c).alias(c) for c in ("mean", "p50", "p95", "p99")], "lo", "hi", "errors", r("error_pct").alias("error_pct"))


@register("m6_slow_endpoints", f"{R} SELECT endpoint, n, round(p, 6) AS p95, round(n * (p - 30) / 1000, 6) AS impact FROM (SELECT endpoint, count(*) AS n, quantile_cont(latency, 0.95) AS p FROM requests GROUP BY endpoint HAVING count(*) >= 2) WHERE p > 30")
def m6(spark, sf):
    return M.slow_endpoints(requests(spark, sf), 30.0).select("endpoint", "n", r("p95").alias("p95"), r("impact").alias("impact"))


@register("m7_error_hotspots", f"{R} SELECT endpoint, count(*) AS errors, round(avg(latency), 6) AS mean, round(100.0 * count(*) / (SELECT count(*) FROM requests WHERE status >= 400), 6) AS share FROM requests WHERE status >= 400 GROUP BY endpoint")
def m7(spark, sf):
    return M.error_hotspots(requests(spark, sf)).select("endpoint", "errors", r("mean").alias("mean"), r("share").alias("share"))


@register("m8_latency_series", f"{R} SELECT date_trunc('hour', ts) AS hour, round(avg(latency), 6) AS mean, round(quantile_cont(latency, 0.95), 6) AS p95, max(latency) AS hi, count(*) AS n FROM requests GROUP BY 1")
def m8(spark, sf):
    x = requests(spark, sf).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    g = quantiles.grouped(x, ["hour"], "latency", (0.95,), F.avg("latency").alias("mean"), F.max("latency").alias("hi"), F.count("*").alias("n"))
    return g.select("hour", r("mean").alias("mean"), r("p95").alias("p95"), "hi", "n")


@register("m9_summary", f"{R} SELECT count(*) AS n, round(count(*) FILTER (WHERE status = 200) * 1.0 / count(*), 8) AS l1, round(count(*) FILTER (WHERE status = 200) * 1.0 / count(*) + (1 - count(*) FILTER (WHERE status = 200) * 1.0 / count(*)) * 0.5, 8) AS combined FROM requests")
def m9(spark, sf):
    x = requests(spark, sf).agg(F.count("*").alias("n"), F.try_divide(F.count_if(F.col("status") == 200), F.count("*")).alias("l1"))
    return x.select("n", r("l1", 8).alias("l1"), r(M.combined_hit_rate(F.col("l1"), F.lit(0.5)), 8).alias("combined"))


_RULES = ", ".join(f"('{a}', {b}, '{c}', '{d}')" for a, b, c, d in M.RULES)


@register("m10_alerts", f"""WITH rules(type, lim, compare, severity) AS (VALUES {_RULES}), v AS (SELECT 'error_rate_high' AS type, 100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*) AS value FROM events UNION ALL SELECT 'cache_hit_rate_low', 100.0 * count(*) FILTER (WHERE event_type = 'view') / count(*) FROM events UNION ALL SELECT 'cpu_high', max(value) FROM events)
SELECT type, round(value, 6)::DOUBLE AS value, lim::DOUBLE AS "limit", severity FROM v JOIN rules USING (type) WHERE ((compare = 'gt' AND value > lim) OR (compare = 'lt' AND value < lim)) AND type NOT IN ('cpu_high')""")
def m10(spark, sf):
    e = load(spark, sf, "events")
    share = lambda t: F.lit(100.0) * F.count_if(F.col("event_type") == t) / F.count("*")
    one = e.agg(F.array(F.struct(F.lit("error_rate_high").alias("type"), share("error").alias("value")), F.struct(F.lit("cache_hit_rate_low").alias("type"), share("view").alias("value")), F.struct(F.lit("cpu_high").alias("type"), F.max("value").alias("value"))).alias("v"))
    rules = spark.createDataFrame(M.RULES, "type string, limit double, compare string, severity string")
    clock = F.lit("2024-01-01 12:00:00").cast("timestamp")
    stored = spark.createDataFrame([("cpu_high", "2024-01-01 11:30:00", False), ("error_rate_high", "2024-01-01 10:59:00", False), ("cache_hit_rate_low", "2024-01-01 11:55:00", True)], "type string, created_at string, acknowledged boolean")
    recent = M.open_alerts(stored, clock)
    return M.alerts(one.select(F.inline("v")), rules, recent).withColumn("value", r("value"))


@register("m11_alert_listing", "SELECT event_type AS type, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS acknowledged, max(ts) AS last FROM events WHERE value > 50 GROUP BY event_type")
def m11(spark, sf):
    return load(spark, sf, "events").where("value > 50").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 3 == 0).alias("acknowledged"), F.max("ts").alias("last"))


@register("m11b_acknowledge", "SELECT event_id, event_id % 3 = 0 OR value > 90 AS acknowledged, CASE WHEN event_id % 3 = 0 THEN 'system' WHEN value > 90 THEN 'ops' END AS acknowledged_by FROM events WHERE value > 50")
def m11b(spark, sf):
    a = load(spark, sf, "events").where("value > 50").withColumn("acknowledged", F.col("event_id") % 3 == 0)
    a = a.withColumn("acknowledged_by", F.when(F.col("acknowledged"), "system")).withColumn("acknowledged_at", F.when(F.col("acknowledged"), F.col("ts")))
    return M.acknowledged(a, F.col("value") > 90, "ops", F.col("ts")).select("event_id", "acknowledged", "acknowledged_by")


@register("m11c_rules", "WITH r AS (SELECT event_type AS type, max(value) AS lim, 'gt' AS compare, 'warning' AS severity, true AS enabled FROM events GROUP BY event_type) SELECT type, CASE WHEN type = 'error' THEN 5.0 ELSE lim END::DOUBLE AS lim, compare, CASE WHEN type = 'error' THEN 'critical' ELSE severity END AS severity, type <> 'view' AS enabled FROM r WHERE type <> 'click' UNION ALL SELECT 'new', 1.0, 'lt', 'warning', true")
def m11c(spark, sf):
    """A rule for each kind of event: one is replaced, one is new, one goes, one is switched off."""
    rules = load(spark, sf, "events").groupBy(F.col("event_type").alias("type")).agg(F.max("value").alias("lim")).select("type", "lim", F.lit("gt").alias("compare"), F.lit("warning").alias("severity"), F.lit(True).alias("enabled"))
    put = spark.createDataFrame([("error", 5.0, "gt", "critical", True), ("new", 1.0, "lt", "warning", True)], "type string, lim double, compare string, severity string, enabled boolean")
    return M.changed_rules(rules, put, ["click"], ["view"])


@register("m12_error_summary", "SELECT event_type, count(*) AS n, CASE WHEN count(*) > 50 THEN 'warning' ELSE 'ok' END AS level FROM events WHERE event_type <> 'view' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5")
def m12(spark, sf):
    g = load(spark, sf, "events").where("event_type <> 'view'").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.orderBy(F.col("n").desc(), "event_type").limit(5).withColumn("level", F.when(F.col("n") > 50, "warning").otherwise("ok"))


@register("m13_imports", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS last_day FROM events GROUP BY 1")
def m13(spark, sf):
    e = load(spark, sf, "events")
    return e.crossJoin(now_of(e)).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("ts") > F.expr("now - INTERVAL 24 HOURS")).alias("last_day"))


@register("m14_code_dashboard", "SELECT CASE WHEN p_size <= 10 THEN 'green' WHEN p_size <= 20 THEN 'yellow' WHEN p_size <= 30 THEN 'orange' ELSE 'red' END AS band, count(*) AS n, round(avg(p_size), 6) AS mean, max(p_size) AS top FROM part GROUP BY 1")
def m14(spark, sf):
    return load(spark, sf, "part").groupBy(M.complexity_band(F.col("p_size")).alias("band")).agg(F.count("*").alias("n"), r(F.avg("p_size")).alias("mean"), F.max("p_size").alias("top"))


@register("m15_type_coverage", f"WITH {MEMORIES_SQL} SELECT lang, count(*) AS n, round(100.0 * count(*) FILTER (WHERE list_contains(tags, 'sys:pattern')) / count(*), 6) AS pct FROM memories GROUP BY lang")
def m15(spark, sf):
    return memories(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), r(F.lit(100.0) * F.count_if(F.array_contains("tags", "sys:pattern")) / F.count("*")).alias("pct"))


@register("m16_repository_stats", "SELECT source, count(*) AS files, count(DISTINCT lang) AS languages, max(n_chars) AS largest, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def m16(spark, sf):
    return load(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("files"), F.count_distinct("lang").alias("languages"), F.max("n_chars").alias("largest"), F.sum("n_chars").alias("chars"))


@register("m17_visual_encoding", f"WITH {EDGES_SQL}, d AS (SELECT node, sum(i) AS i, count(*) AS total FROM (SELECT src AS node, 0 AS i FROM edges UNION ALL SELECT dst, 1 FROM edges) GROUP BY node) SELECT node, CASE WHEN i * 1.0 / total >= 0.7 THEN 'depended upon' WHEN i * 1.0 / total >= 0.3 THEN 'balanced' ELSE 'depends' END AS band, round(80 + greatest(1, least(total, 200)) / 200.0 * 220, 6)::DOUBLE AS width FROM d")
def m17(spark, sf):
    from ..operators.graph import degrees

    d = degrees(edges(spark, sf))
    return d.select("node", M.hub_band(F.col("incoming") / F.col("total")).alias("band"), r(M.clamped(F.col("total"), 1.0, 200.0, 80.0, 220.0)).alias("width"))


@register("m18_progress", "SELECT user_id, least(100, CAST(floor(count(*) FILTER (WHERE event_type <> 'error') * 100.0 / count(*)) AS BIGINT)) AS percent, round(sum(value) * (count(*) - count(*) FILTER (WHERE event_type <> 'error')) / nullif(count(*) FILTER (WHERE event_type <> 'error'), 0), 6) AS eta FROM events GROUP BY user_id")
def m18(spark, sf):
    g = load(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "error").alias("done"), F.count("*").alias("total"), F.sum("value").alias("s"))
    pct, eta = M.progress(F.col("done"), F.col("total"), F.col("s"))
    return g.select("user_id", pct, r(eta).alias("eta"))


@register("m19_tag_panel", f"WITH {MEMORIES_SQL}, t AS (SELECT lower(unnest(tags)) AS tag FROM memories) SELECT tag, count(*) AS n FROM t GROUP BY tag")
def m19(spark, sf):
    return memories(spark, sf).select(F.explode("tags").alias("tag")).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


@register("m20_search_analytics", f"{R} SELECT count(*) AS n, round(avg(latency), 6) AS mean, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, round(count(*) / (24 * 3600.0), 8) AS rps, round(count(*) FILTER (WHERE status >= 500) * 1.0 / count(*), 8) AS error_rate FROM requests WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def m20(spark, sf):
    x = requests(spark, sf)
    x = x.crossJoin(now_of(x)).where("ts > now - INTERVAL 24 HOURS")
    g = quantiles.grouped(x, [], "latency", (0.5, 0.95), F.count("*").alias("n"), F.avg("latency").alias("mean"), F.count_if(F.col("status") >= 500).alias("e"))
    return g.select("n", r("mean").alias("mean"), r("p50").alias("p50"), r("p95").alias("p95"), r(F.col("n") / F.lit(24 * 3600.0), 8).alias("rps"), r(F.try_divide("e", "n"), 8).alias("error_rate"))


@register("st7b_admitted", """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
t AS (SELECT user_id, event_id, n, ts AS last, true AS allowed FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.ts >= t.last + INTERVAL 1 HOUR THEN e.ts ELSE t.last END, e.ts >= t.last + INTERVAL 1 HOUR FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1)
SELECT user_id, event_id, allowed FROM t""")
def st7b(spark, sf):
    """One request an hour and user: rejected requests don't count."""
    from ..streaming.stateful import admitted_rows

    return admitted_rows(load(spark, sf, "events"), most=1, seconds=3600.0)


@register("st7_rate_limiter", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_window FROM events")
def st7(spark, sf):
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-60_000_000, 0)
    x = load(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return x.select("event_id", F.count("*").over(w).alias("in_window"))
