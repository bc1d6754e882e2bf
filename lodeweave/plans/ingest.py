"""Ingest queries: documents as files, conversations as transcripts."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import documents as D
from ..functions import text as X
from ..operators import ingest as I
from ..operators.intervals import containing
from ..sources import files as S
from ..sources.tables import load


def paths(spark, sf):
    """(doc_id, path, text): a file name for each document."""
    kind = F.element_at(F.array(*map(F.lit, ["main.py", "index.ts", "vite.config.ts", "a.spec.ts", "__tests__/b.js", "README.md", "src/x.GO", "noext"])), (F.col("doc_id") % 8 + 1).cast("int"))
    return load(spark, sf, "documents").select("doc_id", F.concat(F.lit("src/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), kind).alias("path"), "text")


PATHS = "paths AS (SELECT doc_id, 'src/' || source || '/' || lang || '/' || ['main.py', 'index.ts', 'vite.config.ts', 'a.spec.ts', '__tests__/b.js', 'README.md', 'src/x.GO', 'noext'][doc_id % 8 + 1] AS path, text FROM documents)"


@register("i1_language", f"WITH {PATHS} SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'typescript' WHEN 4 THEN 'javascript' WHEN 5 THEN 'markdown' WHEN 6 THEN 'go' END AS language FROM paths")
def i1(spark, sf):
    return paths(spark, sf).select("doc_id", S.language(F.col("path")).alias("language"))


@register("i2_file_class", f"WITH {PATHS} SELECT doc_id, CASE WHEN path LIKE '%.spec.ts%' OR path LIKE '%__tests__%' THEN 'test' WHEN path LIKE '%vite.config%' THEN 'config' WHEN path LIKE '%/index.ts' THEN 'potential_barrel' ELSE 'regular' END AS class, (path LIKE '%.spec.ts%' OR path LIKE '%__tests__%') AS skipped FROM paths")
def i2(spark, sf):
    return paths(spark, sf).select("doc_id", I.file_class(F.col("path")).alias("class"), I.skipped(F.col("path")).alias("skipped"))


#: Windows of lines: as many as make up 2000 characters of the mean line, a tenth of them shared with the next window; a window that is not the first and holds under 50 characters ends the list and joins the one before.
def _chunks_sql(table: str, key: str) -> str:
    return f"""fl AS (SELECT {key} AS fk, string_split(text, chr(10)) AS l, length(text) AS size FROM {table}),
fp AS (SELECT *, len(l) AS n, greatest(1, floor(2000 / greatest(size / len(l), 0.001)))::INT AS per FROM fl),
fw AS (SELECT fk, n, per, l, unnest(range(0, n, greatest(1, per - greatest(1, floor(per * 0.1)::INT)))) AS i, generate_subscripts(range(0, n, greatest(1, per - greatest(1, floor(per * 0.1)::INT))), 1) - 1 AS k FROM fp),
fb AS (SELECT fk, k, i + 1 AS start_line, least(i + per, n) AS end_line, array_to_string(l[i + 1:i + per], chr(10)) AS body FROM fw),
fs AS (SELECT *, min(CASE WHEN k > 0 AND length(trim(regexp_replace(body, '[\\n\\r\\t]', ' ', 'g'), ' ')) < 50 THEN k END) OVER (PARTITION BY fk) AS cut FROM fb),
chunked AS (SELECT a.fk, a.k AS n, a.start_line, coalesce(b.end_line, a.end_line) AS end_line, CASE WHEN b.k IS NULL THEN a.body ELSE a.body || chr(10) || b.body END AS body FROM fs a LEFT JOIN fs b ON b.fk = a.fk AND b.k = b.cut AND a.k = b.k - 1 WHERE a.cut IS NULL OR a.k < a.cut)"""


#: Sources made of a document: six words w[1] to w[6] spread over all of its text ('X' where it has none) name what is in them, and the text's length s decides which parts they have, so that there are some dozens of shapes.
WORDS = 6
_W = f"src AS (SELECT doc_id, s, list_transform(range(0, {WORDS}), lambda i: coalesce(v[1 + i * (len(v) - 1) // {WORDS - 1}], 'X')) AS w FROM (SELECT doc_id, coalesce(length(text), 0) AS s, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS v FROM documents))"
ALWAYS = "true"
#: (condition, lines): a class with a method, a coroutine, a decorated function with one inside, one that is too long for a chunk, and a line that breaks the source.
CLASS = ("s % 2 = 0", "class C{1}(Base):\n    \"\"\"{2} {3}\"\"\"\n\n    def m_{2}(self, a_{3}: int) -> str:\n        if a_{3} and self:\n            return g_{4}(a_{3})\n        return os.path.join('{1}')\n\n\n")
ASYNC = ("s % 3 <> 1", "async def f_{5}(x, *, deep=False):\n    for i in range(3):\n        h_{6}(i, deep)\n\n\n")
NESTED = ("s % 5 < 3", "@deco.rator\ndef n_{3}(a_{1}, /, *rest, k_{2}=1, **more):\n    def inner_{4}(y):\n        try:\n            return z_{5}(y)\n        except ValueError:\n            return None\n    while inner_{4}(k_{2}):\n        p_{6}.q_{1}(a_{1} if rest else more)\n    return inner_{4}\n\n\n")
LONG = ("s % 10 = 0", "def big{1}():\n" + "    x = 1\n" * 300 + "\n\n")
BROKEN = ("s % 7 = 0", "def broken_{2}(:\n")
PY = [(ALWAYS, "import os\n\n"), CLASS, ASYNC, NESTED, BROKEN]
PY_LONG = [*PY[:-1], LONG, BROKEN]
TS_HEAD = "import D{1}, {{ a{2}, b as c{3} }} from './{4}'\nimport * as n from 'lib'\nexport {{ x{2} as y{3}, z }} from './z'\nexport * from './all'\n"
TS = [
    (ALWAYS, TS_HEAD), ("s % 2 = 0", "export async function go{5}(p: string, q?: number): Promise<void> {{}}\n"), ("s % 3 <> 1", "export function* gen{6}(a = 1) {{}}\n"),
    ("s % 5 < 3", "export class K{6} {{}}\n"), ("s % 7 < 4", "interface I{1} {{}}\n"), ("s % 4 = 1", "export default function d{2}(m: Map<string, T{3}>, e{4}: string = 'x'): T{5}[] {{}}\n"),
]
BARREL = [(ALWAYS, "// {1}\nexport * from './{2}'\nexport {{ {3}, {4} as d }} from './b'\nexport type {{ {5} }} from './t'\n"), ("s % 3 = 1", "const x = 1\n"), ("s % 3 = 2", "const x = 1\n" * 6)]
HOVER = [("s % 3 = 0", "def f{1}(a{2}: int, b: dict[str, {3}] = {{}}, *c) -> list[tuple[int, {4}]]"), ("s % 3 = 1", "def go_{2}(self, p_{3}: Callable[[int], {4}], *args: {5}) -> None"), ("s % 3 = 2", "class K{1}")]


def _pieces(template: str) -> list[int | str]:
    """A template as its texts and the numbers of its words."""
    return [int(x) if k % 2 else x.replace("{{", "{").replace("}}", "}") for k, x in enumerate(re.split(r"\{(\d)\}", template))]


def made(spark, sf, parts: list[tuple[str, str]]):
    """(doc_id, source): the parts whose condition holds, filled in."""
    v = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))
    d = load(spark, sf, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("s"), v.alias("v"))
    word = lambda i: F.coalesce(F.get("v", F.floor(F.lit(i - 1) * (F.size("v") - 1) / F.lit(WORDS - 1)).cast("int")), F.lit("X"))
    d = d.select("doc_id", "s", *[word(i).alias(f"w{i}") for i in range(1, WORDS + 1)])
    filled = lambda t: F.concat(*[F.col(f"w{x}") if isinstance(x, int) else F.lit(x) for x in _pieces(t)])
    return d.select("doc_id", F.concat(*[F.when(F.expr(c), filled(t)).otherwise("") for c, t in parts]).alias("source"))


def _made_sql(parts: list[tuple[str, str]]) -> str:
    quoted = lambda x: f"w[{x}]" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return " || ".join(f"CASE WHEN {c} THEN {' || '.join(map(quoted, _pieces(t)))} ELSE '' END" for c, t in parts)


def _offset(parts: list[tuple[str, str]], part: tuple[str, str]) -> str:
    """How many lines stand before a part."""
    return " + ".join(f"CASE WHEN {c} THEN {t.count(chr(10))} ELSE 0 END" for c, t in parts[: parts.index(part)])


def _told(parts: list[tuple[str, str]], rows: list[tuple[tuple[str, str], str]], sound: bool = True) -> str:
    """(doc_id, w, s, o, u): a struct u of each row that a part gives, o the lines before the part; broken sources have none."""
    each = [f"SELECT doc_id, w, s, {_offset(parts, part)} AS o, unnest([{structs}]) AS u FROM src WHERE {part[0]}" + (f" AND NOT ({BROKEN[0]})" if sound else "") for part, structs in rows]
    return "told AS (" + " UNION ALL ".join(each) + ")"


@register("i3_barrel", f"WITH {_W} SELECT doc_id, s % 3 <> 2 AS barrel FROM src")
def i3(spark, sf):
    """Files of four re-exported symbols in three lines, some with a line of code besides, some with six."""
    return made(spark, sf, BARREL).select("doc_id", I.barrel(F.col("source")).alias("barrel"))


def _python(f, kind: str):
    """A column function of sources: f's list of dicts as an array of structs."""

    @F.pandas_udf(f"array<struct<{kind}>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(f)

    return run


UNIT = "name:string,kind:string,start_line:int,end_line:int,signature:string,returns:string,params:array<string>,decorators:array<string>,docstring:string,complexity:int,lines:int,calls:array<string>,uses:array<string>,source:string"


_NAMED = """{{'name': {0}, 'kind': '{1}', 'a': {2}, 'b': {3}}}"""
_UNITS = [
    (CLASS, ", ".join((_NAMED.format("'m_' || w[2]", "method", 4, 7), _NAMED.format("'C' || w[1]", "class", 1, 7)))),
    (ASYNC, _NAMED.format("'f_' || w[5]", "function", 1, 3)),
    (NESTED, ", ".join((_NAMED.format("'n_' || w[3]", "function", 2, 10), _NAMED.format("'inner_' || w[4]", "function", 3, 7)))),
]


@register("i4_python_chunks", f"""WITH {_W}, {_told(PY_LONG, _UNITS)},
big AS (SELECT doc_id AS id, CASE WHEN {BROKEN[0]} THEN {_made_sql(PY_LONG)} ELSE 'def big' || w[1] || '():' || repeat(chr(10) || '    x = 1', 300) END AS text FROM src WHERE {LONG[0]} OR {BROKEN[0]}), {_chunks_sql('big', 'id')}
SELECT doc_id, u.name, u.kind, (o + u.a)::INT AS start_line, (o + u.b)::INT AS end_line FROM told UNION ALL SELECT fk, 'chunk_' || n, 'fallback_fixed', start_line::INT, end_line::INT FROM chunked""")
def i4(spark, sf):
    """Chunks of Python sources by their syntax tree; some have a function that is too long for one, some are broken and cut by lines."""
    units = _python(I.python_chunks, "name:string,kind:string,start_line:int,end_line:int,source:string")
    x = made(spark, sf, PY_LONG).select("doc_id", F.explode(units("source")).alias("u"))
    return x.select("doc_id", "u.name", "u.kind", "u.start_line", "u.end_line")


_META = """{{'name': {0}, 'signature': {1}, 'returns': '{2}', 'params': {3}, 'docstring': {4}, 'complexity': {5}, 'lines': {6}, 'calls': {7}, 'uses': '{8}'}}"""
_METAS = [
    (CLASS, ", ".join((
        _META.format("'C' || w[1]", "''", "", "''", "w[2] || ' ' || w[3]", 3, 7, "'join,g_' || w[4]", "os"),
        _META.format("'m_' || w[2]", "'m_' || w[2] || '(self, a_' || w[3] || ': int) -> str'", "str", "'self,a_' || w[3]", "''", 3, 4, "'join,g_' || w[4]", "os"),
    ))),
    (ASYNC, _META.format("'f_' || w[5]", "'f_' || w[5] || '(x, *, deep=False)'", "", "'x,deep'", "''", 2, 3, "'range,h_' || w[6]", "")),
    (NESTED, ", ".join((
        _META.format("'n_' || w[3]", "'n_' || w[3] || '(a_' || w[1] || ', /, *rest, k_' || w[2] || '=1, **more)'", "", "'a_' || w[1] || ',k_' || w[2]", "''", 4, 9, "'inner_' || w[4] || ',q_' || w[1] || ',z_' || w[5]", ""),
        _META.format("'inner_' || w[4]", "'inner_' || w[4] || '(y)'", "", "'y'", "''", 2, 5, "'z_' || w[5]", ""),
    ))),
]


@register("i8_python_metadata", f"WITH {_W}, {_told(PY, _METAS)} SELECT doc_id, u.* FROM told")
def i8(spark, sf):
    x = made(spark, sf, PY).select("doc_id", F.explode(_python(I.python_units, UNIT)("source")).alias("u"))
    listed = lambda c: F.array_join(f"u.{c}", ",").alias(c)
    return x.select("doc_id", "u.name", "u.signature", "u.returns", listed("params"), "u.docstring", "u.complexity", "u.lines", listed("calls"), listed("uses"))


def _line(part: tuple[str, str]) -> str:
    return f"({_offset(TS, part)} + 1)::VARCHAR"


_TS_UNITS = ", ".join(f"CASE WHEN {part[0]} THEN {told} END" for part, told in (
    (TS[1], f"'go' || w[5] || ' function ' || {_line(TS[1])} || ' async p:string,q?:number Promise<void>'"), (TS[2], f"'gen' || w[6] || ' function ' || {_line(TS[2])} || ' generator a?=1 '"),
    (TS[3], f"'K' || w[6] || ' class ' || {_line(TS[3])} || '  '"), (TS[4], f"'I' || w[1] || ' interface ' || {_line(TS[4])} || '  '"),
    (TS[5], f"'d' || w[2] || ' function ' || {_line(TS[5])} || ' m:Map<string, T' || w[3] || '>,e' || w[4] || '?:string=''x'' T' || w[5] || '[]'"),
))


@register("i8b_typescript_metadata", f"""WITH {_W} SELECT doc_id, './' || w[4] || '.a' || w[2] || ',./' || w[4] || '.b,./' || w[4] || ',lib' AS imports, 'y' || w[3] || '<x' || w[2] || ' ./z,z ./z,* ./all' AS re_exports,
array_to_string(list_filter([{_TS_UNITS}], lambda u: u IS NOT NULL), ';') AS units FROM src""")
def i8b(spark, sf):
    @F.pandas_udf("imports string, re_exports string, units string")
    def meta(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for m in map(I.typescript_units, s):
                again = ",".join(f"{e['symbol']}{'<' + e['original'] if e['original'] else ''} {e['source']}" for e in m["re_exports"])
                told = lambda p: p["name"] + "?" * p["optional"] + (":" + p["type"] if p["type"] else "") + ("=" + p["default"] if p["default"] else "")
                units = ";".join(f"{u['name']} {u['kind']} {u['start_line']}{' async' * u['async']}{' generator' * u['generator']} {','.join(map(told, u['params']))} {u['returns']}" for u in m["units"])
                rows.append((",".join(m["imports"]), again, units))
            yield pd.DataFrame(rows, columns=["imports", "re_exports", "units"])

    return made(spark, sf, TS).select("doc_id", meta("source").alias("m")).select("doc_id", "m.*")


_CALL = """{{'scope_type': '{0}', 'scope_name': {1}, 'call_name': {2}, 'line': {3}, 'is_conditional': {4}, 'is_loop': {5}, 'is_try': {6}, 'arguments': {7}}}"""
_N, _T = "false", "true"
_CONTEXTS = [
    (CLASS, ", ".join(_CALL.format(kind, scope, *call) for kind, scope in (("class", "'C' || w[1]"), ("method", "'m_' || w[2]")) for call in (("'g_' || w[4]", 6, _T, _N, _N, 1), ("'join'", 7, _N, _N, _N, 1)))),
    (ASYNC, ", ".join(_CALL.format("function", "'f_' || w[5]", *call) for call in (("'range'", 2, _N, _T, _N, 1), ("'h_' || w[6]", 3, _N, _T, _N, 2)))),
    (NESTED, ", ".join((
        *[_CALL.format("function", "'n_' || w[3]", *call) for call in (("'inner_' || w[4]", 8, _N, _T, _N, 1), ("'q_' || w[1]", 9, _N, _T, _N, 1), ("'z_' || w[5]", 5, _N, _N, _T, 1))],
        _CALL.format("function", "'inner_' || w[4]", "'z_' || w[5]", 5, _N, _N, _T, 1),
    ))),
]


@register("i22_call_contexts", f"WITH {_W}, {_told(PY, _CONTEXTS)} SELECT doc_id, u.scope_type, u.scope_name, u.call_name, (o + u.line)::INT AS line, u.is_conditional, u.is_loop, u.is_try, u.arguments FROM told")
def i22(spark, sf):
    calls = _python(I.call_contexts, "scope_type:string,scope_name:string,call_name:string,line:int,is_conditional:boolean,is_loop:boolean,is_try:boolean,arguments:int")
    return made(spark, sf, PY).select("doc_id", F.explode(calls("source")).alias("c")).select("doc_id", "c.*")


_RETURNS = "CASE s % 3 WHEN 0 THEN 'list[tuple[int, ' || w[4] || ']]' WHEN 1 THEN 'None' END"


@register("i15_hover_types", f"WITH {_W} SELECT doc_id, {_RETURNS} AS returns, CASE s % 3 WHEN 0 THEN 'a' || w[2] || '=int;b=dict[str, ' || w[3] || ']' WHEN 1 THEN 'args=' || w[5] || ';p_' || w[3] || '=Callable[[int], ' || w[4] || ']' ELSE '' END AS params FROM src")
def i15(spark, sf):
    @F.pandas_udf("returns string, params map<string,string>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([I.hover_types(t) for t in s])

    x = made(spark, sf, HOVER).select("doc_id", parse("source").alias("t"))
    return x.select("doc_id", "t.returns", F.array_join(F.transform(F.array_sort(F.map_entries("t.params")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("params"))


@register("i5_fixed_chunks", "SELECT doc_id, count(*) AS lines, max(length(line)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def i5_lines(spark, sf):
    """The line table under the chunker; the chunks themselves are i5b."""
    x = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return x.groupBy("doc_id").agg(F.count("*").alias("lines"), F.max(F.length("line")).cast("long").alias("longest"))


@register("i5b_fixed_chunk_windows", f"WITH {_chunks_sql('documents', 'doc_id')} SELECT fk AS doc_id, n::INT AS n, start_line::INT AS start_line, end_line::INT AS end_line, body FROM chunked")
def i5(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.explode(I.fixed_chunks(F.col("text"))).alias("c")).select("doc_id", "c.*")


_LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM md)"


@register("i6_markdown", f"""WITH md AS (SELECT doc_id, regexp_replace(text, '(^|\\n)(The|Le|La|El|Der|Die) ', '\\1## \\2 ', 'g') AS text FROM documents), {_LINES},
s AS (SELECT *, greatest(1, sum(CASE WHEN regexp_matches(line, '^##\\s+.+') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no)) AS sec FROM ln),
sections AS (SELECT doc_id, sec AS section, coalesce(min(trim(regexp_extract(line, '^##\\s+(.+)$', 1))) FILTER (WHERE regexp_matches(line, '^##\\s+.+')), 'content') AS name, min(no) AS start_line, max(no) AS end_line, string_agg(line, chr(10) ORDER BY no) AS text FROM s GROUP BY doc_id, sec),
big AS (SELECT {{'d': doc_id, 's': section, 'n': name}} AS id, text FROM sections WHERE length(text) > 2000), {_chunks_sql('big', 'id')}
SELECT doc_id, section::BIGINT AS section, 0 AS part, name, start_line::INT AS start_line, end_line::INT AS end_line, text AS body FROM sections WHERE length(text) <= 2000
UNION ALL SELECT fk.d, fk.s::BIGINT, n::INT, fk.n, start_line::INT, end_line::INT, body FROM chunked""")
def i6(spark, sf):
    """Documents as Markdown: lines that begin with an article are headers."""
    md = load(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"(^|\n)(The|Le|La|El|Der|Die) ", "$1## $2 ").alias("text"))
    return I.markdown_chunks(md, "text").drop("text")


@register("i7_single_chunk", f"WITH {PATHS} SELECT doc_id, CASE WHEN path LIKE '%vite.config%' THEN 'config_module' WHEN path LIKE '%/index.ts' THEN 'barrel' END AS chunk_type, length(text) AS size FROM paths WHERE path LIKE '%vite.config%' OR path LIKE '%/index.ts'")
def i7(spark, sf):
    c = I.file_class(F.col("path"))
    kind = F.when(c == "config", "config_module").when(c == "potential_barrel", "barrel")
    return paths(spark, sf).where(kind.isNotNull()).select("doc_id", kind.alias("chunk_type"), F.length("text").cast("long").alias("size"))


@register("i9_changed", "SELECT doc_id FROM documents d LEFT JOIN (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN md5(text) ELSE 'old' END AS h, 100 AS at FROM documents WHERE doc_id % 2 = 0) i ON i.id = d.doc_id WHERE i.id IS NULL OR (d.doc_id % 300 > i.at AND md5(d.text) <> i.h)")
def i9(spark, sf):
    d = load(spark, sf, "documents")
    files = d.select("doc_id", F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 300).alias("modified"), F.col("text").alias("content"))
    done = d.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("path"), F.lit(100).alias("indexed_at"), F.when(F.col("doc_id") % 4 == 0, F.md5("text")).otherwise("old").alias("hash"))
    return I.changed(files, done).select("doc_id")


#: By a path's suffix: its language's leading folders and suffix go, then a last __init__ or index.
_MODULE = "CASE WHEN path LIKE '%.py' THEN regexp_replace(regexp_replace(path, '^((api|src)/)+', ''), '\\.py$', '') WHEN path LIKE '%.ts' THEN regexp_replace(regexp_replace(path, '^(src/)+', ''), '\\.ts$', '') WHEN path LIKE '%.js' THEN regexp_replace(regexp_replace(path, '^(src/)+', ''), '\\.js$', '') WHEN path LIKE '%.GO' THEN path ELSE regexp_replace(path, '^((api|src)/)+', '') END"


@register("i10_name_path", f"WITH {PATHS} SELECT doc_id, replace(regexp_replace({_MODULE}, '(^|/)(__init__|index)$', ''), '/', '.') AS module FROM paths")
def i10(spark, sf):
    """Module names by the rules of each path's language; those of no language by the general ones."""
    kind, name = S.language(F.col("path")), I.module_path(F.col("path"), "")
    for language in I.ROOT_FOLDERS:
        name = F.when(kind == language, I.module_path(F.col("path"), language)).otherwise(name)
    return paths(spark, sf).select("doc_id", name.alias("module"))


@register("i10b_parents", "WITH c AS (SELECT o_custkey AS f, o_orderkey AS id, o_orderkey % 97 AS a, o_orderkey % 97 + o_orderkey % 13 AS b, o_orderkey % 3 = 0 AS cls FROM orders) SELECT c.id, string_agg(p.id, '.' ORDER BY p.a - p.b, p.id) AS outer_ids FROM c JOIN c p ON p.f = c.f AND p.cls AND p.a < c.a AND p.b > c.b GROUP BY c.id")
def i10b(spark, sf):
    o = load(spark, sf, "orders")
    a = F.col("o_orderkey") % 97
    s = o.select(F.col("o_custkey").alias("f"), F.col("o_orderkey").alias("id"), a.alias("a"), (a + F.col("o_orderkey") % 13).alias("b"), (F.col("o_orderkey") % 3 == 0).alias("cls"))
    x = containing(s, s.where("cls"), "f", "a", "b")
    g = x.groupBy(F.col("inner.id").alias("id")).agg(F.sort_array(F.collect_list(F.struct((F.col("outer.a") - F.col("outer.b")).alias("o"), F.col("outer.id").alias("i")))).alias("l"))
    return g.select("id", F.array_join(F.transform("l", lambda v: v["i"].cast("string")), ".").alias("outer_ids"))


@register("i11_mock_embedding")
def i11(spark, sf):
    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: I.mock_embedding(t, 16))

    d = load(spark, sf, "documents")
    return d.select("doc_id", F.when(F.col("text").contains('"""'), "TEXT").otherwise("CODE").alias("domain"), embed("text").alias("embedding"))


@register("i12_limits", f"WITH {PATHS}, kept AS (SELECT doc_id, text FROM paths WHERE NOT (path LIKE '%.d.ts' AND len(string_split(text, chr(10))) > 5000)), {_chunks_sql('kept', 'doc_id')} SELECT source, doc_id, n::INT AS n, start_line::INT AS start_line, end_line::INT AS end_line, body FROM chunked JOIN documents ON doc_id = fk WHERE n < 50")
def i12(spark, sf):
    """Chunks of files: the first 50 of each, none of declaration files of more than 5000 lines."""
    files = paths(spark, sf).join(load(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return I.limited_chunks(files, F.col("path"), F.col("text")).select("source", "doc_id", "c.*")


@register("i13_summary", "SELECT source, count(*) AS files, count(*) FILTER (WHERE n_chars > 0) AS ok, sum(CAST(ceil(n_chars / 2000.0) AS BIGINT))::BIGINT AS chunks FROM documents GROUP BY source")
def i13(spark, sf):
    return load(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("files"), F.count_if(F.col("n_chars") > 0).alias("ok"), F.sum(F.ceil(F.col("n_chars") / 2000).cast("long")).alias("chunks"))


@register("i14_markdown_workspace", "SELECT doc_id, source FROM documents WHERE strlen(text) <= 51200 AND lang = 'en'")
def i14(spark, sf):
    return load(spark, sf, "documents").where((F.octet_length("text") <= 51200) & (F.col("lang") == "en")).select("doc_id", "source")


@register("i16_conversation_memory", "SELECT conv_id, 'Conv: ' || left(text, 60) AS title, 'session:' || left(CAST(conv_id AS VARCHAR), 12) AS tag FROM conversations WHERE role = 'user'")
def i16(spark, sf):
    return load(spark, sf, "conversations").where("role = 'user'").select("conv_id", F.concat(F.lit("Conv: "), F.left("text", F.lit(60))).alias("title"), F.concat(F.lit("session:"), F.left(F.col("conv_id").cast("string"), F.lit(12))).alias("tag"))


@register("i17_error_class", "SELECT event_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'parse' ELSE 'unknown' END AS class FROM events")
def i17(spark, sf):
    message = F.when(F.col("event_type") == "error", "Request Timed Out").when(F.col("event_type") == "click", "SyntaxError: bad").otherwise(F.lit(None).cast("string"))
    return load(spark, sf, "events").select("event_id", I.error_class(message).alias("class"))


@register("i18_log_transforms", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, CASE WHEN event_type = 'error' THEN '5xx' WHEN value >= 50 THEN '4xx' ELSE '2xx' END AS status, CASE user_id % 3 WHEN 0 THEN 'backend-api' WHEN 1 THEN 'background-worker' ELSE 'web' END AS component FROM events WHERE NOT (user_id % 5 = 0 AND event_type <> 'error' AND value < 50)")
def i18(spark, sf):
    e = load(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", 500).when(F.col("value") >= 50, 404).otherwise(200)
    service = F.when(F.col("user_id") % 3 == 0, "the-api").when(F.col("user_id") % 3 == 1, "conversation-queue").otherwise("web")
    path = F.when(F.col("user_id") % 5 == 0, "/health").otherwise("/x")
    kept = e.where(~X.noise_log(path, F.lit("GET"), status))
    level = F.when(F.col("event_type") == "error", "FATAL").otherwise("Notice")
    return kept.select("event_id", X.severity(level).alias("severity"), X.status_class(status).alias("status"), X.service_component(service).alias("component"))


@register("i19_upload_guards", f"WITH {PATHS} SELECT doc_id, doc_id % 8 <> 7 AS safe, length(regexp_replace(left(text, 8192), '[\\x20-\\x7E\\t\\n\\r]', '', 'g')) * 1.0 / length(left(text, 8192)) > 0.3 AS binary FROM paths")
def i19(spark, sf):
    p = F.when(F.col("doc_id") % 8 == 7, F.concat(F.lit("a/../"), F.col("path"))).otherwise(F.col("path"))
    return paths(spark, sf).select("doc_id", X.safe_path(p).alias("safe"), X.binary_like(F.col("text")).alias("binary"))


@register("i19b_normalize_path", f"WITH {PATHS} SELECT doc_id, path FROM paths")
def i19b(spark, sf):
    messy = F.concat(F.lit("  ./"), F.regexp_replace("path", "/", r"\\\\"), F.lit("// "))
    return paths(spark, sf).select("doc_id", X.normalize_path(messy).alias("path"))


@register("i20_auto_embedding_text", "SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.text')), ''), nullif(trim(json_extract_string(props, '$.k')), '')) AS source FROM events")
def i20(spark, sf):
    return load(spark, sf, "events").select("event_id", D.first_text(F.col("props"), ["text", "k"]).alias("source"))


@register("i21_admission", f"WITH {PATHS} SELECT coalesce(CASE WHEN strlen(text) > 20000 THEN 'too large' END, 'taken') AS status, count(*) AS n FROM paths WHERE NOT coalesce(length(regexp_replace(left(text, 8192), '[\\x20-\\x7E\\t\\n\\r]', '', 'g')) * 1.0 / length(left(text, 8192)) > 0.3, false) GROUP BY 1")
def i21(spark, sf):
    x = S.admit(paths(spark, sf).withColumnRenamed("text", "content"), 20_000).where("reject is null or reject <> 'binary'")
    return x.groupBy(F.coalesce("reject", F.lit("taken")).alias("status")).agg(F.count("*").alias("n"))


@register("udf_sql", f"WITH {_W} SELECT doc_id, CASE WHEN {CLASS[0]} AND NOT ({BROKEN[0]}) THEN 'g_' || w[4] || ',join' ELSE '' END AS calls, {_RETURNS} AS returns FROM src")
def udf_sql(spark, sf):
    """Registered functions from SQL text."""
    from ..functions.registry import register_functions

    register_functions(spark)
    x = made(spark, sf, PY).withColumnRenamed("source", "py").join(made(spark, sf, HOVER).select("doc_id", F.col("source").alias("hover")), "doc_id")
    return spark.sql("SELECT doc_id, array_join(array_sort(array_distinct(transform(filter(call_contexts(py), c -> c.scope_type = 'class'), c -> c.call_name))), ',') AS calls, hover_types(hover).returns AS returns FROM {x}", x=x)
