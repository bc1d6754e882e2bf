"""Code-graph queries over documents as chunks of code.

A document is a chunk: its file is a path made of its source, language and number, its name its first word, its kind
follows from its number. It calls its words, and imports and re-exports from files beside it."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import codegraph as C
from ..sources.tables import load

FILES = ["main.py", "index.ts", "vite.config.ts", "a.spec.ts", "lib/b.js", "README.md", "src/x.go", "noext"]
KINDS = ["class", "method", "function", "interface", "barrel", "config_module", "fallback_fixed"]
STEMS = ["main", "index", "vite.config", "missing"]
_PICK = lambda words, n: f"[{', '.join(map(repr, words))}][{n} % {len(words)} + 1]"
_WORDS = "regexp_extract_all(text, '[A-Za-z]+')"
_CALLS = "list_distinct(w)"

CHUNKS = f"""chunks AS (SELECT doc_id AS id, file, CASE WHEN doc_id % 11 = 0 THEN 'anonymous_' || doc_id WHEN doc_id % 13 = 0 THEN '' ELSE coalesce(w[1], '') END AS name, {_PICK(KINDS, 'doc_id')} AS chunk_type, w, lang, source,
  CASE WHEN doc_id % 17 <> 0 AND len(w) > 0 THEN replace(regexp_replace(file, '\\.[A-Za-z]+$', ''), '/', '.') || '.' || w[1] END AS name_path
  FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'packages/' || lang || '/src/' || source || '/' ELSE 'src/' || source || '/' || lang || '/' END || {_PICK(FILES, 'doc_id')} AS file, {_WORDS} AS w FROM documents)),
nodes AS (SELECT id, CASE chunk_type WHEN 'class' THEN 'Class' WHEN 'interface' THEN 'Class' WHEN 'barrel' THEN 'Module' WHEN 'config_module' THEN 'Config' ELSE 'Function' END AS node_type, CASE WHEN name = '' THEN chunk_type || '_' || left(id::VARCHAR, 8) ELSE name END AS name, file, source, lang FROM chunks WHERE chunk_type <> 'fallback_fixed' AND NOT starts_with(name, 'anonymous')),
imports AS (SELECT id, file, unnest(['./' || {_PICK(STEMS, 'id')} || '.' || coalesce(w[2], 'X'), '../' || lang || '/index.' || coalesce(w[3], 'X'), 'vue.ref', '@/core/api.' || coalesce(w[1], 'X')]) AS target FROM chunks)"""


def _pick(words, n):
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


def chunks(spark, sf):
    """(id, file, name, chunk_type, w, lang, source, name_path)"""
    i = F.col("doc_id")
    folder = F.when(i % 3 == 0, F.concat_ws("/", F.lit("packages"), "lang", F.lit("src"), "source", F.lit(""))).otherwise(F.concat_ws("/", F.lit("src"), "source", "lang", F.lit("")))
    d = load(spark, sf, "documents").withColumn("file", F.concat(folder, _pick(FILES, i))).withColumn("w", F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)))
    first = F.get("w", F.lit(0))
    name = F.when(i % 11 == 0, F.concat(F.lit("anonymous_"), i.cast("string"))).when(i % 13 == 0, "").otherwise(F.coalesce(first, F.lit("")))
    path = F.when(i % 17 != 0, F.concat(F.regexp_replace(F.regexp_replace("file", r"\.[A-Za-z]+$", ""), "/", "."), F.lit("."), first))
    return d.select(i.alias("id"), "file", name.alias("name"), _pick(KINDS, i).alias("chunk_type"), "w", "lang", "source", path.alias("name_path"))


def imports(c):
    w = lambda n: F.coalesce(F.get("w", F.lit(n)), F.lit("X"))
    specs = F.array(F.concat(F.lit("./"), _pick(STEMS, F.col("id")), F.lit("."), w(1)), F.concat(F.lit("../"), "lang", F.lit("/index."), w(2)), F.lit("vue.ref"), F.concat(F.lit("@/core/api."), w(0)))
    return c.select("id", "file", F.explode(specs).alias("target"))


def between_nodes(edges, c):
    """Edges both of whose ends are nodes."""
    n = C.graph_nodes(c)
    return edges.join(n.select(F.col("node_id").alias("src")), "src", "left_semi").join(n.select(F.col("node_id").alias("dst")), "dst", "left_semi")


@register("g14_graph_nodes", f"WITH {CHUNKS} SELECT id AS node_id, node_type, name AS label, CASE WHEN starts_with(file, 'packages/') THEN lang END AS parent_package, source AS parent_module FROM nodes")
def g14(spark, sf):
    return C.graph_nodes(chunks(spark, sf)).select("node_id", "node_type", "label", "parent_package", "parent_module")


_KEYS = """tails AS (SELECT id, file, name_path, unnest(list_distinct(list_transform(range(1, len(string_split(name_path, '.')) + 1), lambda i: array_to_string(string_split(name_path, '.')[i:], '.')))) AS key FROM chunks WHERE name_path IS NOT NULL)"""


@register("g15_call_edges", f"""WITH {CHUNKS}, {_KEYS}, calls AS (SELECT DISTINCT id, file, unnest({_CALLS}) AS callee FROM chunks),
asked AS (SELECT * FROM calls WHERE callee NOT IN ({', '.join(map(repr, C.BUILTINS))})),
met AS (SELECT a.id, a.callee, count(t.id) AS n, count(t.id) FILTER (WHERE t.file = a.file) AS m, arg_min(t.id, (t.name_path, t.id)) AS least, min(t.id) FILTER (WHERE t.file = a.file) AS own FROM asked a LEFT JOIN tails t ON t.key = a.callee GROUP BY a.id, a.callee),
placed AS (SELECT s.id, s.callee, CASE WHEN n > 1 AND m = 1 THEN own WHEN n > 0 THEN least ELSE coalesce((SELECT min(c.id) FROM chunks c WHERE c.name = s.callee AND c.file = (SELECT file FROM chunks o WHERE o.id = s.id)), CASE WHEN EXISTS (SELECT 1 FROM imports i WHERE i.id = s.id AND ends_with(i.target, s.callee)) THEN (SELECT min(c.id) FROM chunks c WHERE c.name = s.callee) END) END AS dst FROM met s)
SELECT id AS src, dst, callee FROM placed WHERE dst IN (SELECT id FROM nodes) AND id IN (SELECT id FROM nodes)""")
def g15(spark, sf):
    c = chunks(spark, sf)
    calls = c.select("id", "file", F.explode(F.array_distinct("w")).alias("callee"))
    return between_nodes(C.resolve_calls(calls, c, imports(c)), c).select("src", "dst", "callee")


@register("g16_import_edges", f"""WITH {CHUNKS}, {_KEYS}, ask AS (SELECT id, file, target, trim(split_part(target, '.', -1)) AS symbol, string_split(string_split(target, '/')[-1], '.')[1] AS hint, regexp_replace(file, '/?[^/]*$', '') AS folder FROM imports WHERE target <> 'vue.ref'),
path AS (SELECT a.id, a.target, count(t.id) AS n, min(t.id) AS least, min(t.id) FILTER (WHERE contains(t.file, a.hint)) AS best FROM ask a LEFT JOIN tails t ON t.key = a.symbol GROUP BY a.id, a.target),
named AS (SELECT a.id, a.target, count(c.id) AS n, min(c.id) AS least, min(c.id) FILTER (WHERE starts_with(c.file, a.folder)) AS best FROM ask a LEFT JOIN chunks c ON c.name = a.symbol GROUP BY a.id, a.target),
placed AS (SELECT p.id AS src, p.target, CASE WHEN p.n = 1 THEN p.least WHEN p.n > 1 THEN coalesce(p.best, p.least) WHEN m.n = 1 THEN m.least ELSE coalesce(m.best, m.least) END AS dst FROM path p JOIN named m USING (id, target))
SELECT src, dst, target FROM placed WHERE dst IN (SELECT id FROM nodes) AND src IN (SELECT id FROM nodes)""")
def g16(spark, sf):
    c = chunks(spark, sf)
    return between_nodes(C.resolve_imports(imports(c), c), c).select("src", "dst", "target")


@register("g17_reexport_edges", f"""WITH {CHUNKS}, again AS (SELECT id, file, unnest(list_concat(w, ['*'])) AS symbol, CASE WHEN id % 2 = 0 THEN './' ELSE '../' || lang || '/main' END AS source, lang FROM chunks WHERE chunk_type = 'barrel'),
pre AS (SELECT DISTINCT id, symbol, CASE WHEN id % 2 = 0 THEN regexp_replace(file, '/[^/]*$', '') ELSE regexp_replace(regexp_replace(file, '/[^/]*$', ''), '/[^/]*$', '') || '/' || lang || '/main' END AS prefix FROM again WHERE symbol <> '*')
SELECT p.id AS src, min(c.id) AS dst, symbol FROM pre p JOIN chunks c ON c.name = p.symbol AND starts_with(c.file, p.prefix) GROUP BY p.id, symbol""")
def g17(spark, sf):
    c = chunks(spark, sf)
    again = c.where("chunk_type = 'barrel'").select("id", "file", F.explode(F.array_distinct(F.concat("w", F.array(F.lit("*"))))).alias("symbol"), F.when(F.col("id") % 2 == 0, "./").otherwise(F.concat(F.lit("../"), "lang", F.lit("/main"))).alias("source"))
    return C.reexport_edges(again, c)


@register("g18_contains_edges", f"""WITH {CHUNKS}, f AS (SELECT DISTINCT file, source FROM chunks), m AS (SELECT DISTINCT source, lang FROM chunks WHERE starts_with(file, 'packages/'))
SELECT 'package:' || lang AS src, 'module:' || source || ':' || lang AS dst, 'package_to_module' AS level FROM m
UNION ALL SELECT (SELECT min('module:' || m.source || ':' || m.lang) FROM m WHERE m.source = f.source), 'file:' || file, 'module_to_file' FROM f WHERE source IN (SELECT source FROM m)
UNION ALL SELECT 'file:' || file, 'chunk:' || id, 'file_to_entity' FROM nodes WHERE node_type IN ('Class', 'Function')""")
def g18(spark, sf):
    """Packages are languages, modules a package's sources, files the chunks' files; of modules of one name the first holds the files."""
    c = chunks(spark, sf)
    own = C.graph_nodes(c).where("node_type in ('Class', 'Function')").withColumn("node_id", F.concat(F.lit("chunk:"), F.col("node_id").cast("string")))
    none = F.lit(None).cast("string")
    made = lambda x, kind, key, label, file, package, module: x.select(F.concat(F.lit(f"{kind.lower()}:"), key).alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label"), file.alias("file"), package.alias("parent_package"), module.alias("parent_module"), none.alias("parent_folder"))
    packaged = c.where(F.startswith("file", F.lit("packages/")))
    packages = made(packaged.select("lang").distinct(), "Package", F.col("lang"), F.col("lang"), none, none, none)
    modules = made(packaged.select("source", "lang").distinct(), "Module", F.concat("source", F.lit(":"), "lang"), F.col("source"), none, F.col("lang"), none)
    files = made(c.select("file", "source").distinct(), "File", F.col("file"), F.col("file"), F.col("file"), none, F.col("source"))
    return C.contains_edges(own.unionByName(packages).unionByName(modules).unionByName(files))


_MODULES = f"""{CHUNKS}, files AS (SELECT DISTINCT file FROM chunks), spec AS (SELECT DISTINCT file, regexp_replace(target, '\\.[^.]*$', '') AS target FROM imports WHERE target <> 'vue.ref'),
based AS (SELECT file, target, CASE WHEN starts_with(target, '@/') THEN '/app/src/' || substr(target, 3) WHEN starts_with(target, './') THEN regexp_replace(file, '/[^/]*$', '') || substr(target, 2) ELSE regexp_replace(regexp_replace(file, '/[^/]*$', ''), '/[^/]*$', '') || substr(target, 3) END AS base FROM spec),
tried AS (SELECT file, target, unnest(['.ts', '.tsx', '.js', '.jsx', '.py', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '']) AS e, generate_subscripts(['.ts', '.tsx', '.js', '.jsx', '.py', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', ''], 1) AS n, base FROM based),
medges AS (SELECT t.file AS src, target, arg_min(base || e, n) AS dst FROM tried t JOIN files f ON f.file = base || e GROUP BY t.file, target)"""


@register("g19_module_graph", f"WITH {_MODULES} SELECT src, target, dst FROM medges")
def g19(spark, sf):
    c = chunks(spark, sf)
    return C.module_edges(imports(c), c)


@register("g19b_isolation", f"WITH {_MODULES} SELECT total_files, total_edges, isolated_files, round(isolated_files * 1.0 / total_files, 8)::DOUBLE AS isolation_rate FROM (SELECT (SELECT count(*) FROM files) AS total_files, (SELECT count(*) FROM medges) AS total_edges, (SELECT count(*) FROM files WHERE file NOT IN (SELECT src FROM medges) AND file NOT IN (SELECT dst FROM medges)) AS isolated_files)")
def g19b(spark, sf):
    c = chunks(spark, sf)
    return C.isolation(C.module_edges(imports(c), c), c).withColumn("isolation_rate", F.round("isolation_rate", 8))
