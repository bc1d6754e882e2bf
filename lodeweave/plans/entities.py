"""Entity, relationship and consolidation queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import documents as D
from ..operators import relations as R
from ..operators.lineage import cut
from ..sources.tables import ENTITIES_SQL, MEMORIES_SQL, entities, load, memories, names

M = f"WITH {MEMORIES_SQL}"


def r(c, n=6):
    return F.round(c, n)


def near(c, n=6):
    """Like round for values that are not negative and far from 2^53 / 10^n, without decimals, since there are very many of them."""
    return F.when(F.isnan(c), F.col(c)).otherwise(F.floor(F.col(c) * 10.0**n + 0.5) / 10.0**n)


@register("e1_extract_post", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '\\p{L}+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{4,}')), lambda x: lower(x)))), ' ') AS names FROM documents")
def e1(spark, sf):
    """Deterministic extractor in the place of a model, and the model's post-processing: length, presence in the text, one of each."""
    found = names("text", 4)
    return load(spark, sf, "documents").select("doc_id", F.array_join(F.sort_array(F.array_distinct(F.transform(found, F.lower))), " ").alias("names"))


@register("e2_extractable", f"{M} SELECT id, (lang IN ('en', 'de') OR list_has_any(tags, ['sys:pattern', 'sys:core'])) AS ok FROM memories")
def e2(spark, sf):
    return memories(spark, sf).select("id", (F.col("lang").isin("en", "de") | D.any_tag(F.col("tags"), ["sys:pattern", "sys:core"])).alias("ok"))


@register("e3_auto_tags", "SELECT p_partkey, array_to_string(list_sort(list_distinct([replace(lower(p_name), ' ', '-'), lower(p_type)])), ',') AS tags FROM part")
def e3(spark, sf):
    t = F.array(F.regexp_replace(F.lower("p_name"), " ", "-"), F.lower("p_type"))
    return load(spark, sf, "part").select("p_partkey", F.array_join(F.sort_array(F.array_distinct(t)), ",").alias("tags"))


@register("e4_entity_frequency", f"WITH {ENTITIES_SQL} SELECT name, count(*) AS df FROM ent GROUP BY name")
def e4(spark, sf):
    return R.entity_frequency(entities(spark, sf))


_PAIRS = f"""{ENTITIES_SQL}, tot AS (SELECT count(*) AS n FROM documents), freq AS (SELECT name, count(*) AS df FROM ent GROUP BY name),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, sum(ln(greatest(1, tot.n) * 1.0 / df)) AS shared_idf FROM ent a JOIN ent b ON a.name = b.name AND a.id < b.id JOIN freq ON freq.name = a.name CROSS JOIN tot GROUP BY ALL)"""


#: Two memories are held against each other if they share an entity, a concept (language and source) or a tag.
_RELATED = """sz AS (SELECT id, count(*) AS n FROM ent GROUP BY id), marks AS (SELECT id, [lang, source] AS c, tags AS t FROM memories),
cand AS (SELECT a, b FROM pairs UNION SELECT x.id, y.id FROM marks x JOIN marks y ON x.id < y.id AND (list_has_any(x.c, y.c) OR list_has_any(x.t, y.t))),
scored AS (SELECT a, b, coalesce(shared, 0) AS shared, len(list_intersect(x.c, y.c)) AS cons, len(list_intersect(x.t, y.t)) AS tags,
  least(1.0, 0.5 * coalesce(shared_idf, 0) / greatest(1, coalesce(m.n, 0) + coalesce(k.n, 0) - coalesce(shared, 0)) + 0.3 * len(list_intersect(x.c, y.c)) / greatest(1, len(list_distinct(list_concat(x.c, y.c)))) + 0.2 * len(list_intersect(x.t, y.t)) / greatest(1, len(list_distinct(list_concat(x.t, y.t))))) AS score
  FROM cand LEFT JOIN pairs USING (a, b) JOIN marks x ON x.id = a JOIN marks y ON y.id = b LEFT JOIN sz m ON m.id = a LEFT JOIN sz k ON k.id = b)"""


@register("e5_relationship", f"WITH {MEMORIES_SQL}, {_PAIRS}, {_RELATED} SELECT a, b, round(score, 6) AS score, array_to_string(list_filter([CASE WHEN shared > 0 THEN 'shared_entity' END, CASE WHEN cons > 0 THEN 'shared_concept' END, CASE WHEN tags > 0 THEN 'shared_tag' END], lambda v: v IS NOT NULL), ',') AS types FROM scored WHERE score >= 0.1")
def e5(spark, sf):
    total = load(spark, sf, "documents").count()
    marks = memories(spark, sf).select("id", F.array("lang", "source").alias("concepts"), "tags")
    return R.relationships(entities(spark, sf), marks, total).withColumn("score", near("score"))


@register("e6_store_relationships", "WITH new AS (SELECT o_custkey AS a, o_orderkey AS b, o_totalprice AS score FROM orders WHERE o_orderkey % 3 = 0), old AS (SELECT o_custkey AS a, o_orderkey AS b, 0.0 AS score FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b, coalesce(n.score, o.score)::DOUBLE AS score FROM old o FULL JOIN new n ON n.a = o.a AND n.b = o.b")
def e6(spark, sf):
    from ..operators.store import upsert

    o = load(spark, sf, "orders")
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), F.col("o_totalprice").alias("score"))
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), F.lit(0.0).alias("score"))
    return upsert(old, new, ["a", "b"])


_CONS = f"WITH {MEMORIES_SQL}, {_PAIRS}, mass AS (SELECT id, sum(ln(tot.n * 1.0 / df)) AS m FROM ent JOIN freq USING (name) CROSS JOIN tot GROUP BY id), sc AS (SELECT a, b, shared, 0.6 * shared_idf / greatest(1.0, x.m + y.m - shared_idf) + 0.4 * len(list_intersect([s.lang, s.source], [t.lang, t.source])) * 1.0 / len(list_distinct([s.lang, s.source, t.lang, t.source])) AS score FROM pairs JOIN mass x ON x.id = a JOIN mass y ON y.id = b JOIN memories s ON s.id = a JOIN memories t ON t.id = b)"


@register("e7_consolidation_pairs", f"{_CONS} SELECT a, b, shared, round(score, 6) AS score FROM sc WHERE round(score, 9) >= 0.3")
def e7(spark, sf):
    total = load(spark, sf, "documents").count()
    concepts = memories(spark, sf).select("id", F.array("lang", "source").alias("concepts"))
    # the score is compared to nine digits; that of two without concepts is NaN, as in SQL
    found = R.consolidation_pairs(entities(spark, sf), concepts, total, 0.3 - 5e-10, bare=float("nan")).where(near("score", 9) >= 0.3)
    return found.select("a", "b", "shared", near("score").alias("score"))


@register("e8_consolidation_groups")
def e8(spark, sf):
    """Greedy groups: the order of pairs matters; the first of them act by the list rule, which settles most of the others."""
    concepts = memories(spark, sf).select("id", F.array("lang", "source").alias("concepts"))
    total = load(spark, sf, "documents").count()
    e = cut(entities(spark, sf))
    own = cut(concepts.join(e.groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("names")), "id"))

    def told(x):
        """What the ends of pairs share, for those that act only."""
        x = x.join(own.select(F.col("id").alias("a"), F.col("concepts").alias("ca"), F.col("names").alias("na")), "a")
        x = x.join(own.select(F.col("id").alias("b"), F.col("concepts").alias("cb"), F.col("names").alias("nb")), "b")
        return x.withColumns({"entities": F.array_intersect("na", "nb"), "concepts": F.array_compact(F.array_intersect("ca", "cb"))}).drop("ca", "cb", "na", "nb")

    made = R.grouped_pairs(R.consolidation_pairs(e, concepts, total, 0.3), sets=told)
    # no group holds a member of another, so none is mostly in a better one
    title = F.udf(lambda e, c: R.title_of(R.Group([], set(e), set(c), 0.0)), "string")
    return made.select(F.col("group").alias("component"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), r("score").alias("score"), title("entities", "concepts").alias("title"))


@register("e9b_backfill", f"WITH {_PAIRS}, sz AS (SELECT id, count(*) AS n FROM ent GROUP BY id) SELECT a, b, round(least(1.0, shared_idf / greatest(1, x.n + y.n - shared)), 6) AS score FROM pairs JOIN sz x ON x.id = a JOIN sz y ON y.id = b")
def e9b(spark, sf):
    found = R.backfill(entities(spark, sf), load(spark, sf, "documents").count())
    return found.select("a", "b", near("score").alias("score"))


@register("e10_candidates", f"{M} SELECT id FROM memories WHERE created_at >= (SELECT max(created_at) FROM memories) - INTERVAL 30 DAY AND (lang = 'en' OR list_has_any(tags, ['x:candidate']))")
def e10(spark, sf):
    """Memories of the last 30 days before the newest one."""
    m = memories(spark, sf)
    newest = F.broadcast(m.agg(F.max("created_at").alias("now")))
    return m.crossJoin(newest).where((F.col("created_at") >= F.col("now") - F.make_dt_interval(days=F.lit(30))) & ((F.col("lang") == "en") | D.any_tag(F.col("tags"), ["x:candidate"]))).select("id")


@register("e11_consolidate", f"{M} SELECT id, title, array_to_string(tags, ',') AS tags, deleted_at IS NOT NULL OR source = 'src1' AS deleted FROM memories UNION ALL SELECT 1000000 + max(id), 'Summary of ' || count(*), 'src1:summary,sys:consolidated', false FROM memories WHERE source = 'src1' AND deleted_at IS NULL")
def e11(spark, sf):
    m = memories(spark, sf)
    gone = F.col("source") == "src1"
    old = m.select("id", "title", F.array_join("tags", ",").alias("tags"), (F.col("deleted_at").isNotNull() | gone).alias("deleted"))
    new = m.where(gone & F.col("deleted_at").isNull()).agg((F.lit(1000000) + F.max("id")).alias("id"), F.concat(F.lit("Summary of "), F.count("*").cast("string")).alias("title"))
    return old.unionByName(new.select("id", "title", F.lit("src1:summary,sys:consolidated").alias("tags"), F.lit(False).alias("deleted")))


@register("e12_mark_consumed", f"{M} SELECT id, consumed_at IS NOT NULL OR (deleted_at IS NULL AND lang = 'fr') AS consumed, consumed_at IS NOT NULL AS already FROM memories")
def e12(spark, sf):
    mark = F.col("deleted_at").isNull() & (F.col("lang") == "fr")
    return memories(spark, sf).select("id", (F.col("consumed_at").isNotNull() | mark).alias("consumed"), F.col("consumed_at").isNotNull().alias("already"))


@register("e13_rate", f"{M}, rating AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type <> 'error') AS up, count(*) FILTER (WHERE event_type = 'error') AS down FROM events GROUP BY user_id) SELECT id, outcome_positive + coalesce(up, 0) AS pos, outcome_negative + coalesce(down, 0) AS neg FROM memories LEFT JOIN rating USING (id)")
def e13(spark, sf):
    bad = F.col("event_type") == "error"
    rating = load(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count_if(~bad).alias("up"), F.count_if(bad).alias("down"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return memories(spark, sf).join(rating, "id", "left").select("id", (F.col("outcome_positive") + zero("up")).alias("pos"), (F.col("outcome_negative") + zero("down")).alias("neg"))


#: Tags that a memory has by its number, for the sections of a snapshot; a source is a project.
_SYSTEM = {"sys:core": 9, "sys:anchor": 6, "sys:pattern": 4, "sys:pattern:candidate": 3, "sys:extension": 7, "sys:user:profile": 11, "sys:protocol": 5, "sys:trace": 8, "sys:history": 10, "sys:drift": 12, "trace:fresh": 13}
_SYSTEM_SQL = f"{M}, sm AS (SELECT *, list_concat(list_filter([{', '.join(f'CASE WHEN id % {n} = 0 THEN {t!r} END' for t, n in _SYSTEM.items())}], lambda t: t IS NOT NULL), ['sys:project:' || source]) AS st FROM memories WHERE deleted_at IS NULL)"


def system_memories(spark, sf):
    tags = F.array(*[F.when(F.col("id") % n == 0, t) for t, n in _SYSTEM.items()], F.concat(F.lit("sys:project:"), "source"))
    return memories(spark, sf).withColumn("tags", F.array_compact(tags))


_FIRST = " UNION ALL ".join(f"(SELECT {n} AS n, '{section}' AS section, id, st, row_number() OVER (ORDER BY created_at DESC, id) AS pos FROM sm WHERE list_contains(st, '{tag + 'src1' if tag.endswith(':') else tag}') QUALIFY pos <= {most})" for n, (section, tag, most) in enumerate(R.SNAPSHOT))


@register("e14_snapshot", f"{_SYSTEM_SQL}, first AS ({_FIRST}), told AS (SELECT CASE WHEN section = 'patterns' AND list_contains(st, '{R.CANDIDATE}') THEN 'candidates' ELSE section END AS section, id, min(n * 1000 + pos) AS spot FROM first GROUP BY ALL) SELECT section, id, row_number() OVER (PARTITION BY section ORDER BY spot) AS place FROM told QUALIFY section <> 'candidates' OR place <= {R.CANDIDATES}")
def e14(spark, sf):
    return R.snapshot(system_memories(spark, sf), "src1")


@register("e14b_snapshot_health", f"{_SYSTEM_SQL}, h AS (SELECT count(*) FILTER (WHERE list_contains(st, 'sys:history')) AS history_count, count(*) FILTER (WHERE list_contains(st, 'sys:drift') AND consumed_at IS NULL) AS fresh_drifts, count(*) FILTER (WHERE list_contains(st, 'trace:fresh') AND consumed_at IS NULL) AS fresh_traces, count(*) FILTER (WHERE list_contains(st, '{R.CANDIDATE}') AND consumed_at IS NULL) AS candidates_pending, count(*) AS total_memories, count(*) FILTER (WHERE list_contains(st, 'sys:protocol')) AS protocol_count, count(*) FILTER (WHERE list_contains(st, 'sys:trace')) AS trace_count FROM sm) SELECT *, history_count > 20 AS needs_consolidation FROM h")
def e14b(spark, sf):
    return R.snapshot_health(system_memories(spark, sf))


@register("e15_health", f"{M} SELECT count(*) AS total, count(*) FILTER (WHERE deleted_at IS NULL) AS live, count(*) FILTER (WHERE list_contains(tags, 'x:doubt')) AS doubts, round(avg(outcome_positive) FILTER (WHERE outcome_positive > 0), 6) AS mean_up FROM memories")
def e15(spark, sf):
    return memories(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_if(F.array_contains("tags", "x:doubt")).alias("doubts"), r(F.avg(F.when(F.col("outcome_positive") > 0, F.col("outcome_positive")))).alias("mean_up"))


@register("e16_resolve_or_create", "WITH want AS (SELECT DISTINCT lower(source) AS name FROM documents UNION SELECT DISTINCT 'NEW' || lang FROM documents), known AS (SELECT DISTINCT lower(source) AS name FROM documents WHERE doc_id % 2 = 0) SELECT lower(name) AS name, lower(name) IN (SELECT name FROM known) AS known FROM want")
def e16(spark, sf):
    d = load(spark, sf, "documents")
    known = d.where("doc_id % 2 = 0").select(F.lower("source").alias("name")).distinct().withColumn("k", F.lit(True))
    want = d.select(F.lower("source").alias("name")).unionByName(d.select(F.lower(F.concat(F.lit("NEW"), "lang")).alias("name"))).distinct()
    return want.join(known, "name", "left").select("name", F.coalesce("k", F.lit(False)).alias("known"))


@register("e17_event_to_memory", "SELECT event_id, event_type || ' of user ' || user_id AS title, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts AS created_at FROM events")
def e17(spark, sf):
    return load(spark, sf, "events").select("event_id", F.concat("event_type", F.lit(" of user "), F.col("user_id").cast("string")).alias("title"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("ts").alias("created_at"))
