"""Projections, filters and predicates."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import documents as D
from ..functions import text as X
from ..sources.tables import MEMORIES_SQL, REQUESTS_SQL, load, memories, names, requests


def now_of(events):
    """One row: the latest event time, the clock of all relative windows."""
    return F.broadcast(events.agg(F.max("ts").alias("now")))


@register("f1_json_containment", "SELECT event_id, ts FROM events WHERE json_extract_string(props, '$.k') = '87' ORDER BY ts DESC, event_id LIMIT 20")
def f1(spark, sf):
    return load(spark, sf, "events").where(D.json_contains(F.col("props"), {"k": 87})).select("event_id", "ts").orderBy(F.col("ts").desc_nulls_first(), "event_id").limit(20)


@register("f2_object_array_containment", "SELECT doc_id FROM documents WHERE list_contains(list_filter(regexp_extract_all(text, '\\p{L}+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}')), 'Tion') OR list_contains(list_filter(regexp_extract_all(text, '\\p{L}+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}')), 'Reason') OR list_contains(list_filter(regexp_extract_all(text, '\\p{L}+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}')), 'Hand')")
def f2(spark, sf):
    found = F.transform(names("text", 3), lambda n: F.struct(n.alias("name")))
    wanted = ["Tion", "Reason", "Hand"]
    return load(spark, sf, "documents").where(F.exists(found, lambda e: e["name"].isin(*wanted))).select("doc_id")


@register("f3_time_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01 02:00:00' AND TIMESTAMP '2024-01-01 20:00:00'")
def f3(spark, sf):
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-01 02:00:00", "2024-01-01 20:00:00"))
    return load(spark, sf, "events").where(F.col("ts").between(lo, hi)).select("event_id")


@register("f4_relative_window", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def f4(spark, sf):
    e = load(spark, sf, "events")
    return e.crossJoin(now_of(e)).where("ts > now - INTERVAL 24 HOURS").select("event_id")


#: Period names and their lengths.
PERIODS = {"1h": timedelta(hours=1), "6h": timedelta(hours=6), "24h": timedelta(hours=24), "7d": timedelta(days=7), "30d": timedelta(days=30)}


def parse_period(period: str, now: datetime) -> tuple[datetime | None, datetime]:
    """(start, end) of a named period; 'all' has no start, unknown names are one day."""
    return (None if period == "all" else now - PERIODS.get(period, timedelta(days=1))), now


@register("f5_period", "SELECT count(*) FILTER (WHERE ts >= m - INTERVAL 1 HOUR) AS h1, count(*) FILTER (WHERE ts >= m - INTERVAL 6 HOUR) AS h6, count(*) FILTER (WHERE ts >= m - INTERVAL 7 DAY) AS d7, count(*) AS everything FROM events, (SELECT max(ts) AS m FROM events)")
def f5(spark, sf):
    e = load(spark, sf, "events")
    since = lambda p: F.count_if(F.col("ts") >= F.col("now") - F.make_dt_interval(secs=F.lit(float(PERIODS[p].total_seconds()))))
    return e.crossJoin(now_of(e)).agg(since("1h").alias("h1"), since("6h").alias("h6"), since("7d").alias("d7"), F.count("*").alias("everything"))


@register("f6_equality_filters", "SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src3'")
def f6(spark, sf):
    return load(spark, sf, "documents").where("lang = 'fr' AND source = 'src3'").select("doc_id")


@register("f7_like", "SELECT page_id, url FROM pages WHERE url LIKE '%example.com/fr%'")
def f7(spark, sf):
    return load(spark, sf, "pages").where(F.col("url").like("%example.com/fr%")).select("page_id", "url")


@register("f8_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%WIDGET%'")
def f8(spark, sf):
    return load(spark, sf, "part").where(F.col("p_name").ilike("%WIDGET%")).select("p_partkey", "p_name")


@register("f9_any_value_ilike", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') ILIKE '%9%'")
def f9(spark, sf):
    values = F.map_values(F.from_json("props", "map<string,string>"))
    return load(spark, sf, "events").where(F.exists(values, lambda v: v.ilike("%9%"))).select("event_id")


def _m(sql: str) -> str:
    return f"WITH {MEMORIES_SQL} {sql}"


@register("f10_tags_all", _m("SELECT id FROM memories WHERE list_has_all(tags, ['en', 'sys:pattern'])"))
def f10(spark, sf):
    return memories(spark, sf).where(D.all_tags(F.col("tags"), ["en", "sys:pattern"])).select("id")


@register("f11_tags_any", _m("SELECT id FROM memories WHERE list_has_any(tags, ['src1', 'x:candidate'])"))
def f11(spark, sf):
    return memories(spark, sf).where(D.any_tag(F.col("tags"), ["src1", "x:candidate"])).select("id")


@register("f12_consumed_or_fresh", _m("SELECT id, consumed_at IS NOT NULL AS consumed FROM memories"))
def f12(spark, sf):
    return memories(spark, sf).select("id", F.col("consumed_at").isNotNull().alias("consumed"))


@register("f13_lifecycle", _m("SELECT CASE WHEN len(list_filter(tags, lambda t: t LIKE '%:candidate')) > 0 THEN 'candidate' WHEN len(list_filter(tags, lambda t: t LIKE '%:doubt')) > 0 THEN 'doubt' ELSE 'sealed' END AS state, count(*) AS n FROM memories GROUP BY 1"))
def f13(spark, sf):
    return memories(spark, sf).groupBy(D.lifecycle(F.col("tags")).alias("state")).agg(F.count("*").alias("n"))


@register("f14_auto_tags", _m("SELECT id FROM memories WHERE list_contains(tags, 'en') OR lower(title) LIKE '%tion%'"))
def f14(spark, sf):
    m = memories(spark, sf)
    return m.where(F.array_contains("tags", "en") | D.auto_tag_match(F.array("source"), F.lower("title"), ["TION"])).select("id")


@register("f15_soft_delete_visible", _m("SELECT id FROM memories WHERE deleted_at IS NULL"))
def f15(spark, sf):
    return memories(spark, sf).where("deleted_at IS NULL").select("id")


@register("f16_guarded_cast", "SELECT event_id, CASE WHEN regexp_matches(json_extract_string(props, '$.k'), '^[0-9]+\\.?[0-9]*$') THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events")
def f16(spark, sf):
    k = F.get_json_object("props", "$.k")
    return load(spark, sf, "events").select("event_id", F.when(k.rlike(r"^[0-9]+\.?[0-9]*$"), k.try_cast("double")).alias("k"))


@register("f17_projections", "SELECT doc_id, left(text, 200) AS head, split_part(left(text, 50), chr(10), 1) AS line, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS preview, text IS NOT NULL AS has_text FROM documents")
def f17(spark, sf):
    t = F.col("text")
    return load(spark, sf, "documents").select("doc_id", F.left(t, F.lit(200)).alias("head"), F.substring_index(F.left(t, F.lit(50)), "\n", 1).alias("line"), X.pad_preview(t).alias("preview"), t.isNotNull().alias("has_text"))


@register("f18_age_text", "SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' ELSE (s // 3600) || 'h ago' END AS age FROM (SELECT event_id, date_diff('second', date_trunc('second', ts), date_trunc('second', (SELECT max(ts) FROM events))) AS s FROM events)")
def f18(spark, sf):
    e = load(spark, sf, "events")
    s = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.crossJoin(now_of(e)).select("event_id", X.age_text(s).alias("age"))


@register("f19_json_default", "SELECT event_id, coalesce(json_extract_string(props, '$.severity'), 'info') AS severity, coalesce(json_extract_string(props, '$.k'), 'unknown') AS k FROM events")
def f19(spark, sf):
    return load(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.severity"), F.lit("info")).alias("severity"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("unknown")).alias("k"))


@register("f20_noise_filter", f"WITH {REQUESTS_SQL} SELECT endpoint, count(*) AS n FROM requests WHERE endpoint NOT LIKE '/u/1%' GROUP BY endpoint")
def f20(spark, sf):
    return requests(spark, sf).where(~F.col("endpoint").like("/u/1%")).groupBy("endpoint").agg(F.count("*").alias("n"))


@register("fn_normalize_endpoint", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '/:uuid', 'g'), '(?i)/[0-9a-f]{32,}', '/:hash', 'g'), '/[0-9]+', '/:id', 'g') AS endpoint FROM pages")
def fn_endpoint(spark, sf):
    return load(spark, sf, "pages").select("page_id", X.normalize_endpoint(F.col("url")).alias("endpoint"))


@register("fn_hash_keys", "SELECT doc_id, left(sha256(text), 16) AS key, md5(text) AS m FROM documents")
def fn_hash(spark, sf):
    return load(spark, sf, "documents").select("doc_id", X.short_hash(F.col("text")).alias("key"), F.md5("text").alias("m"))


@register("fn_tags_normalized", "SELECT doc_id, array_to_string(list_value(lower(trim(' ' || lang || ' ')), lower(source)), ',') AS tags FROM documents")
def fn_tags(spark, sf):
    raw = F.array(F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")), F.lit(" "), F.upper("source"), F.col("lang"))
    return load(spark, sf, "documents").select("doc_id", F.array_join(D.normalized_tags(raw), ",").alias("tags"))
