"""Scans, sources, sinks and changes to tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import documents as D
from ..operators import ingest as I
from ..operators import store as T
from ..operators.lineage import folder
from ..sources import files as S
from ..sources.tables import EDGES_SQL, MEMORIES_SQL, NODES_SQL, edges, load, memories, nodes
from .ingest import PATHS, paths


@register("s1_point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def s1(spark, sf):
    return load(spark, sf, "customer").where("c_custkey = 42").select("c_custkey", "c_name")


@register("s2_exists", "SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = 3) AS here, EXISTS (SELECT 1 FROM orders WHERE o_custkey = -1) AS there")
def s2(spark, sf):
    o = load(spark, sf, "orders")
    any_ = lambda k, n: o.where(F.col("o_custkey") == k).limit(1).agg((F.count("*") > 0).alias(n))
    return any_(3, "here").crossJoin(any_(-1, "there"))


@register("s3_scan_by_json_key", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def s3(spark, sf):
    return load(spark, sf, "events").where(F.get_json_object("props", "$.k") == "7").select("event_id")


@register("s7_exchanges", """WITH x AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations),
g AS (SELECT conv_id, min(turn) AS start, max(text) FILTER (WHERE role = 'user') AS u, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant') AS a FROM x WHERE e > 0 GROUP BY conv_id, e)
SELECT conv_id, start, left(sha256(u || a), 16) AS key FROM g WHERE length(u) >= 5 AND length(a) >= 5 QUALIFY row_number() OVER (PARTITION BY left(sha256(u || a), 16) ORDER BY conv_id, start) = 1""")
def s7(spark, sf):
    return I.exchanges(load(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "start", "key")


@register("s12_upsert", "SELECT d.doc_id, coalesce(l.quality, d.q) AS quality FROM (SELECT doc_id, -1 AS q FROM documents) d FULL JOIN labels l USING (doc_id)")
def s12(spark, sf):
    old = load(spark, sf, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return T.upsert(old, load(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"])


@register("s13_json_merge", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE json_extract_string(props, '$.k') END AS k, 'x' AS extra FROM events")
def s13(spark, sf):
    base = F.from_json("props", "map<string,string>")
    patch = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("even"), F.lit("extra"), F.lit("x"))).otherwise(F.create_map(F.lit("extra"), F.lit("x")))
    m = D.merged(base, patch)
    return load(spark, sf, "events").select("event_id", m["k"].alias("k"), m["extra"].alias("extra"))


@register("s14_soft_delete", f"WITH {MEMORIES_SQL} SELECT id, deleted_at IS NOT NULL OR lang = 'es' AS deleted, deleted_at IS NOT NULL AS restorable FROM memories")
def s14(spark, sf):
    return memories(spark, sf).select("id", (F.col("deleted_at").isNotNull() | (F.col("lang") == "es")).alias("deleted"), F.col("deleted_at").isNotNull().alias("restorable"))


@register("s15_delete_by_predicate", "SELECT doc_id FROM documents WHERE source NOT LIKE 'src1%'")
def s15(spark, sf):
    return load(spark, sf, "documents").where(~F.col("source").like("src1%")).select("doc_id")


@register("s16_cascade", f"WITH {EDGES_SQL}, {NODES_SQL}, gone AS (SELECT node_id FROM nodes WHERE node_id % 3 = 0) SELECT src, dst FROM edges WHERE src NOT IN (SELECT node_id FROM gone) AND dst NOT IN (SELECT node_id FROM gone)")
def s16(spark, sf):
    n = nodes(spark, sf)
    return T.delete_nodes(n, edges(spark, sf), n.where("node_id % 3 = 0").select("node_id"))[1].select("src", "dst")


@register("s17_generator", "SELECT n_nationkey AS k, 5000 * (n_nationkey + 1)::BIGINT AS n, 4::BIGINT AS types, 10::BIGINT AS tenants, true AS in_range, true AS again FROM nation")
def s17(spark, sf):
    """A load for each nation, of another size and seed: all rows of all kinds and tenants, inside their days, and the same a second time."""
    out = None
    for k in [x[0] for x in load(spark, sf, "nation").select("n_nationkey").collect()]:
        g = S.generated_events(spark, 5000 * (k + 1), seed=k)
        same = S.generated_events(spark, 5000 * (k + 1), seed=k)
        sum_ = lambda x: x.agg(F.sum(F.xxhash64(*x.columns).cast("decimal(38,0)")).alias("h"))
        inside = F.min((F.col("timestamp") >= "2024-01-01") & (F.col("timestamp") < "2024-03-31"))
        one = g.agg(F.count("*").alias("n"), F.count_distinct("type").alias("types"), F.count_distinct("tenant").alias("tenants"), inside.alias("in_range"))
        one = one.crossJoin(sum_(g).crossJoin(sum_(same).withColumnRenamed("h", "h2")).select((F.col("h") == F.col("h2")).alias("again"))).withColumn("k", F.lit(k).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("k").cast(load(spark, sf, "nation").schema["n_nationkey"].dataType).alias("k"), "n", "types", "tenants", "in_range", "again")


@register("s18_sample")
def s18(spark, sf):
    return load(spark, sf, "lineitem").sample(0.01, seed=42)


@register("s20_prefetch", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_orderkey), 0)::BIGINT AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def s20(spark, sf):
    more = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    x = T.prefetch(load(spark, sf, "customer").select("c_custkey"), more, "c_custkey")
    return x.select("c_custkey", F.size("related").cast("long").alias("n"), F.aggregate("related", F.lit(0).cast("long"), lambda s, v: s + v["o_orderkey"]).alias("keys"))


IGNORE = ["build/", "*.log", "# notes", "docs/*.md", "!docs/keep*.md", "/top.d/", "**/gen/**", "a/**/z*.py", "x[0-9]y.py", "src/only"]
#: Forms of paths, and whether a scan keeps them.
SCANNED = [
    ("%.md", True), ("lib/%.py", True), (".hidden/%.py", False), ("build/%.py", False), ("%.log", False), ("docs/%.md", False), ("docs/keep%.md", True), ("docs/in/%.md", True),
    ("top.d/%.py", False), ("sub/top.d/%.py", True), ("p/gen/q/%.py", False), ("a/z%.py", False), ("a/b/c/z%.py", False), ("k/x7y.py/%.py", False), ("k/x77y.py/%.py", True),
    ("src/only/%.py", False), ("lib/src/only/%.py", True), ("rebuild/%.py", True), ("lib/%.txt", False), ("buildings/%.py", True),
]


def _forms(forms: list[tuple[str, bool]]):
    """The path of each document: forms in turn, with its id."""
    each = F.array(*[F.lit(f) for f, _ in forms])
    return F.replace(F.element_at(each, (F.col("doc_id") % len(forms) + 1).cast("int")), F.lit("%"), F.col("doc_id").cast("string"))


def _forms_sql(forms: list[tuple[str, bool]]) -> str:
    return "replace(CASE doc_id % {} {} END, '%', doc_id::VARCHAR)".format(len(forms), " ".join(f"WHEN {i} THEN '{f}'" for i, (f, kept) in enumerate(forms) if kept))


@register("s4_project_scan", f"SELECT {_forms_sql(SCANNED)} AS path, CASE WHEN {_forms_sql(SCANNED)} LIKE '%.md' THEN 'markdown' ELSE 'python' END AS language, length(text) AS size FROM documents WHERE {_forms_sql(SCANNED)} IS NOT NULL")
def s4(spark, sf):
    """Documents as files of many forms of paths. The scan of a folder itself is sources.files.scan_project."""
    d = load(spark, sf, "documents").select(_forms(SCANNED).alias("path"), F.col("text").cast("binary").alias("content"), F.lit(None).cast("timestamp").alias("modified"))
    return S.project_files(d, IGNORE).select("path", "language", F.length("content").cast("long").alias("size"))


BATCHED = [
    ("src/%.ts", True), ("src/%.spec.ts", False), ("node_modules/%.ts", False), ("src/xgit/%.ts", True), (".git/%.ts", False), ("src/dist/a/%.ts", False), ("src/distant/%.ts", True),
    ("app/__tests__/%.ts", False), ("app/%.test.tsx", False), ("app/vitest.config.%.ts", False), ("vitest.setup%.ts", False), ("lib/test_%.py", True), ("lib/%.d.ts", True), ("lib/%.TS", False), ("lib/%.tsx", False),
]


@register("s5_batch_scan", f"SELECT {_forms_sql(BATCHED)} AS path FROM documents WHERE {_forms_sql(BATCHED)} IS NOT NULL")
def s5(spark, sf):
    return S.batch_files(load(spark, sf, "documents").select(_forms(BATCHED).alias("path")), [".ts", ".py"])


@register("s6_transcripts", "SELECT 's' || conv_id AS session, turn, role, text FROM conversations WHERE conv_id % 5 <> 4 AND turn % 7 <> 6")
def s6(spark, sf):
    """Turns as lines of transcripts; every fifth conversation is an agent's, every seventh turn a broken line."""
    line = F.to_json(F.struct(F.struct("role", F.col("text").alias("content")).alias("message"), F.col("turn").cast("string").alias("timestamp")))
    file = F.concat(F.lit("logs/"), F.when(F.col("conv_id") % 5 == 4, "agent-").otherwise("s"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    lines = load(spark, sf, "conversations").select(file.alias("file"), F.col("turn").alias("line"), F.when(F.col("turn") % 7 == 6, F.concat(F.lit("{"), line)).otherwise(line).alias("value"))
    return S.transcript_lines(lines).select("session", F.col("line").alias("turn"), "role", "text")


@register("s8_upload", f"WITH {PATHS} SELECT doc_id, path, CASE WHEN text = '' THEN 'missing content' WHEN length(regexp_replace(left(text, 8192), '[\\x20-\\x7E\\t\\n\\r]', '', 'g')) * 1.0 / length(left(text, 8192)) > 0.3 THEN 'binary' WHEN strlen(text) > 20000 THEN 'too large' END AS reject FROM paths")
def s8(spark, sf):
    return S.admit(paths(spark, sf).withColumnRenamed("text", "content"), 20_000).select("doc_id", "path", "reject")


@register("s10_insert", "SELECT n_nationkey AS id, n_name AS name, true AS stored FROM nation")
def s10(spark, sf):
    """The rows that an insert gives back, and whether the table has them."""
    t = T.Table(spark, f"{folder(spark)}/insert-{uuid.uuid4().hex}", "id long, name string", required=("name",))
    back = t.insert(load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")))
    return back.join(t.read().withColumn("stored", F.lit(True)), ["id", "name"], "left").select("id", "name", F.coalesce("stored", F.lit(False)).alias("stored"))


@register("s11_batch_insert", """WITH a AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0)
SELECT id, 'first' AS batch, 'stored' AS state FROM a UNION ALL SELECT id, 'second', 'refused: key is stored' FROM b WHERE id IN (SELECT id FROM a) UNION ALL SELECT id, 'third', 'stored' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def s11(spark, sf):
    """A batch that goes in, one that holds stored keys and is refused as a whole, and the same row by row."""
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    t = T.Table(spark, f"{folder(spark)}/batches-{uuid.uuid4().hex}", o.schema.simpleString()[7:-1].replace(":", " "))
    first, _ = t.insert_all(o.where("id % 2 = 0"))
    second, _ = t.insert_all(o.where("id % 3 = 0"))
    third, refused = t.insert_all(o.where("id % 3 = 0"), one_by_one=True)
    told = lambda x, batch, state: x.select("id", F.lit(batch).alias("batch"), state.alias("state"))
    return told(first, "first", F.lit("stored")).unionByName(told(second, "second", F.lit("stored"))).unionByName(told(refused, "second", F.concat(F.lit("refused: "), "fault"))).unionByName(told(third, "third", F.lit("stored")))


@register("s19_table_sizes", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, {n}::BIGINT AS columns FROM {t}" for t, n in (("documents", 5), ("orders", 6), ("labels", 3), ("embeddings", 3))))
def s19(spark, sf):
    """Rows and columns of stored tables; files and bytes are in operators.monitoring.storage."""
    from ..operators.monitoring import storage

    out = None
    for name in ("documents", "orders", "labels", "embeddings"):
        t = load(spark, sf, name)
        one = storage(t).select(F.lit(name).alias("name"), "n", F.lit(len(t.columns)).cast("long").alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out
