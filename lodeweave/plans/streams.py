"""Batch forms of the streaming operators; tests hold the streams against them."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..sources.tables import load
from ..streaming import jobs as J
from ..streaming import windows as W


@register("st_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf):
    return W.tumbling(load(spark, sf, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@register("st_sliding", "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start FROM events UNION ALL SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE FROM events) GROUP BY start")
def sliding(spark, sf):
    return W.sliding(load(spark, sf, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("st_session", "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k")
def session(spark, sf):
    x = W.sessions(load(spark, sf, "events"))
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@register("st_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT event_id FROM events)")
def dedup(spark, sf):
    e = load(spark, sf, "events")
    return W.deduplicated(e.unionByName(e)).agg(F.count("*").alias("n"))


@register("st6_progress", "SELECT event_type AS job, count(*) AS files, count(*) FILTER (WHERE value > 50) AS failed FROM events GROUP BY event_type")
def st6(spark, sf):
    done = load(spark, sf, "events").select(F.col("event_type").alias("job"), F.lit(1).alias("files"), (F.col("value") > 50).cast("int").alias("failed"))
    return J.progress(done)


@register("st10_ring_buffer", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def st10(spark, sf):
    return J.last_rows(load(spark, sf, "events")).select("event_id")


@register("st11_request_metrics", "SELECT '/p/:id' AS endpoint, count(*) AS n FROM events")
def st11(spark, sf):
    e = load(spark, sf, "events").select("ts", F.concat(F.lit("/p/"), F.col("user_id").cast("string")).alias("path"), F.col("value").alias("latency"))
    return J.request_metrics(e).groupBy("endpoint").agg(F.count("*").alias("n"))


@register("st1_messages", """WITH f AS (SELECT 'doc/' || doc_id AS path, row_number() OVER (ORDER BY 'doc/' || doc_id) - 1 AS n FROM documents), m AS (SELECT n // 40 AS k, count(*) AS files, min(path) AS first, max(path) AS last FROM f GROUP BY n // 40)
SELECT k, files, first, last FROM m WHERE k > (SELECT max(k) FROM m) - 1000""")
def st1(spark, sf):
    """A job's files in messages of forty, of which a queue keeps the newest thousand."""
    files = load(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))
    m = J.trimmed(J.messages(files, "job"))
    return m.select("k", F.size("paths").cast("long").alias("files"), F.array_min("paths").alias("first"), F.array_max("paths").alias("last"))


@register("st3_pending", """WITH m AS (SELECT event_id AS id, event_id % 3 = 0 AS acked, ts, user_id % 4 AS attempts, event_type = 'error' AND value > 90 AS critical, epoch((SELECT max(ts) FROM events)) - epoch(ts) AS age FROM events),
a AS (SELECT *, CASE WHEN critical THEN 'stop' WHEN attempts >= 3 THEN 'dead' WHEN age >= 60 THEN 'claim' ELSE 'wait' END AS action FROM m WHERE NOT acked)
SELECT id, action, CASE WHEN action = 'claim' THEN least(60.0, 5.0 * power(2, greatest(attempts, 1) - 1))::DOUBLE END AS retry_in FROM a""")
def st3(spark, sf):
    e = load(spark, sf, "events")
    now = e.agg(F.max("ts")).first()[0]
    error = F.when((F.col("event_type") == "error") & (F.col("value") > 90), "critical")
    m = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 3 == 0).alias("acked"), F.col("ts").alias("delivered_at"), (F.col("user_id") % 4).alias("attempts"), F.coalesce(error, F.lit("none")).alias("error"))
    return J.pending(m, str(now))


@register("st5_complete", "WITH r AS (SELECT o_custkey AS job, count(*) AS done, count(*) FILTER (WHERE o_totalprice > 200000) AS failed FROM orders GROUP BY o_custkey) SELECT job, done - job % 3 + 1 AS files, failed FROM r WHERE done >= done - job % 3 + 1")
def st5(spark, sf):
    """Jobs are customers; a third of them await one file more than there are results."""
    o = load(spark, sf, "orders")
    done = o.select(F.col("o_custkey").alias("job"), F.lit(1).alias("files"), (F.col("o_totalprice") > 200000).cast("int").alias("failed"))
    status = o.groupBy(F.col("o_custkey").alias("job")).agg((F.count("*") - F.col("o_custkey") % 3 + 1).alias("files"))
    return J.complete(status, done)


@register("st9_window_metrics", """WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL),
g AS (SELECT start, 100.0 * sum(CASE WHEN event_type = 'error' THEN n ELSE 0 END) / sum(n) AS e, sum(CASE WHEN total / n > 50 THEN n ELSE 0 END) AS s, sum(n) AS r FROM w GROUP BY start)
SELECT start, 'error_rate_high' AS type, round(e, 6)::DOUBLE AS value FROM g UNION ALL SELECT start, 'slow_queries', s::DOUBLE FROM g UNION ALL SELECT start, 'requests', r::DOUBLE FROM g""")
def st9(spark, sf):
    return J.window_metrics(W.tumbling(load(spark, sf, "events"), "5 minutes")).select(F.col("start").cast("timestamp_ntz").alias("start"), "type", F.round("value", 6).alias("value"))
