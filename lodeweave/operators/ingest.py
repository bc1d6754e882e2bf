"""Ingest operators: exchanges, chunking, classification, names, metadata, embeddings."""
from __future__ import annotations

import ast
import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .intervals import containing


def exchanges(turns: DataFrame, session: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """(session, start, user_text, assistant_text, key): each user turn of five characters or more with the assistant turns up to the next; one row per distinct exchange."""
    w = Window.partitionBy(session).orderBy(order)
    is_user = (F.col(role) == "user")
    x = turns.withColumn("__e", F.sum(is_user.cast("int")).over(w)).where("__e > 0")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(role) == "assistant", F.struct(order, text)))), lambda s: s[text]), "\n")
    g = x.groupBy(session, "__e").agg(F.min(order).alias("start"), F.max(F.when(is_user, F.col(text))).alias("user_text"), F.count_if(F.col(role) == "assistant").alias("__n"), said.alias("assistant_text"))
    g = g.where((F.length("user_text") >= 5) & (F.col("__n") > 0) & (F.length("assistant_text") >= 5))
    g = g.withColumn("key", X.short_hash(F.concat("user_text", "assistant_text")))
    first = g.groupBy("key").agg(F.min_by(F.struct(session, "start", "user_text", "assistant_text"), F.struct(session, "start")).alias("v"))
    return first.select("v.*", "key")


def fixed_chunks(text: Column, size: int = 2000) -> Column:
    """Array of (n, start_line, end_line, body): lines in windows of about size characters that overlap by a tenth; a tail of under 50 characters joins the window before."""
    chars = F.length(text)

    def windows(lines: Column) -> Column:
        n = F.size(lines)
        per = F.greatest(F.lit(1), F.floor(F.lit(size) / F.greatest(chars / n, F.lit(0.001)))).cast("int")
        step = F.greatest(F.lit(1), per - F.greatest(F.lit(1), F.floor(per * 0.1).cast("int")))
        body = lambda i: F.array_join(F.slice(lines, i + 1, per), "\n")
        return F.transform(F.sequence(F.lit(0), n - 1, step), lambda i, k: F.struct(k.alias("n"), (i + 1).alias("start_line"), F.least(i + per, n).alias("end_line"), body(i).alias("body")))

    def merged(found: Column) -> Column:
        # the first window that is too short (never the first of all) joins the one before and ends the list
        tail = F.get(F.filter(found, lambda c: (c["n"] > 0) & (F.length(F.trim(F.regexp_replace(c["body"], r"[\n\r\t]", " "))) < 50)), F.lit(0))
        return X.let(tail, lambda t: F.when(t.isNull(), found).otherwise(joined(found, t)))

    def joined(found: Column, tail: Column) -> Column:
        last = lambda c: F.struct(c["n"].alias("n"), c["start_line"].alias("start_line"), tail["end_line"].alias("end_line"), F.concat(c["body"], F.lit("\n"), tail["body"]).alias("body"))
        return F.transform(F.slice(found, F.lit(1), tail["n"]), lambda c: F.when(c["n"] == tail["n"] - 1, last(c)).otherwise(c))

    return X.let(F.split(text, "\n"), lambda lines: X.let(windows(lines), merged))


def limited_chunks(files: DataFrame, path: Column, text: Column, most: int = 50, lines: int = 5000) -> DataFrame:
    """files with c, a row for each of the first ``most`` fixed chunks of a file; .d.ts files of more than ``lines`` lines are skipped."""
    long = path.endswith(".d.ts") & (F.size(F.split(text, "\n")) > lines)
    return files.where(~F.coalesce(long, F.lit(False))).withColumn("c", F.explode(F.slice(fixed_chunks(text), 1, most)))


def markdown_sections(text: Column) -> Column:
    """Array of (name, start_line, end_line, body): sections from one '## ' line to the next; what stands before the first belongs to it; without such lines one section 'content'."""
    header = r"^##\s+.+"

    def heads(lines: Column) -> Column:
        return F.filter(F.transform(lines, lambda l, i: F.when(l.rlike(header), i + 1)), lambda i: i.isNotNull())

    def sections(lines: Column, heads: Column) -> Column:
        starts = F.concat(F.array(F.lit(1)), F.slice(heads, F.lit(2), F.greatest(F.size(heads), F.lit(1))))
        name = lambda k: F.when(k > 0, F.trim(F.regexp_extract(F.get(lines, k - 1), r"^##\s+(.+)$", 1))).otherwise("content")
        body = lambda a, b: F.array_join(F.slice(lines, a, b - a + 1), "\n")
        named = F.when(F.size(heads) > 0, heads).otherwise(F.array(F.lit(0)))
        ends = lambda s: F.concat(F.transform(F.slice(s, F.lit(2), F.size(s)), lambda i: i - 1), F.array(F.size(lines)))
        spans = X.let(starts, lambda s: F.arrays_zip(s.alias("s"), ends(s).alias("e")))
        return F.zip_with(spans, named, lambda p, k: F.struct(name(k).alias("name"), p["s"].alias("start_line"), p["e"].alias("end_line"), body(p["s"], p["e"]).alias("body")))

    return X.let(F.split(text, "\n"), lambda lines: X.let(heads(lines), lambda h: sections(lines, h)))


def markdown_chunks(files: DataFrame, text: str, size: int = 2000) -> DataFrame:
    """files with section, name, start_line, end_line, body: a row a section; a longer one is cut by fixed_chunks, whose lines count from the section's first."""
    x = files.select("*", F.posexplode(markdown_sections(F.col(text))).alias("__k", "__s"))
    whole = F.array(F.struct(F.lit(0).alias("n"), F.col("__s.start_line").alias("start_line"), F.col("__s.end_line").alias("end_line"), F.col("__s.body").alias("body")))
    x = x.withColumn("__c", F.explode(F.when(F.length("__s.body") > size, fixed_chunks(F.col("__s.body"), size)).otherwise(whole)))
    return x.select(*[F.col(f"`{c}`") for c in files.columns], (F.col("__k") + 1).cast("long").alias("section"), F.col("__c.n").alias("part"), F.col("__s.name").alias("name"), F.col("__c.start_line").alias("start_line"), F.col("__c.end_line").alias("end_line"), F.col("__c.body").alias("body"))


# Name parts by which files are classed.
TEST_PARTS = [".spec.ts", ".spec.js", ".test.ts", ".test.js", "__tests__", ".spec.tsx", ".test.tsx"]
CONFIG_PARTS = ["vite.config", "vitest.config", "tailwind.config", "webpack.config", "rollup.config", "esbuild.config", "tsconfig", "babel.config", ".eslintrc", "prettier.config", "jest.config"]
BARREL_NAMES = ["index.ts", "index.js", "index.tsx", "index.jsx"]


def _any(text: Column, parts: list[str]) -> Column:
    return text.rlike("|".join(re.escape(p) for p in parts))


def file_class(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(_any(path, TEST_PARTS), "test").when(_any(name, CONFIG_PARTS), "config").when(name.isin(*BARREL_NAMES), "potential_barrel").otherwise("regular")


def skipped(path: Column) -> Column:
    return (file_class(path) == "test") | path.contains("node_modules")


def barrel(source: Column) -> Column:
    """Whether there are over 0.8 re-exported symbols for each line that is neither blank nor a comment."""
    code = F.filter(F.split(F.trim(source), "\n"), lambda l: (F.trim(l) != "") & ~F.trim(l).startswith("//"))
    again = F.regexp_extract_all(source, F.lit(r"(export\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s)"), F.lit(1))
    symbols = lambda e: F.when(e.contains("{"), F.size(F.filter(F.split(F.regexp_extract(e, r"\{([^}]*)\}", 1), ","), lambda x: F.trim(x) != ""))).otherwise(1)
    n = F.aggregate(F.transform(again, symbols), F.lit(0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(n, F.size(code)) > 0.8, F.lit(False))


# Leading folders that are no part of a module's name, and file suffixes, by language.
ROOT_FOLDERS = {"python": ["api", "src"], "javascript": ["src"], "typescript": ["src"], "go": ["pkg"], "java": ["src", "main", "java"], "php": ["src", "app"]}
SUFFIXES = {"python": [".py"], "javascript": [".js", ".jsx"], "typescript": [".ts", ".tsx"], "go": [".go"], "java": [".java"], "php": [".php"]}


def module_path(path: Column, language: str = "python") -> Column:
    """Dotted module name of a relative path; 'root' for none."""
    roots = "|".join(ROOT_FOLDERS.get(language, ["api", "src"]))
    ends = "|".join(re.escape(s) for s in SUFFIXES.get(language, [".py", ".js", ".ts", ".go", ".java"]))
    p = F.regexp_replace(path, f"^(({roots})/)+", "")
    p = F.regexp_replace(p, f"({ends})$", "")
    p = F.regexp_replace(p, "(^|/)(__init__|index)$", "")
    return F.when(p == "", "root").otherwise(F.regexp_replace(p, "/", "."))


def name_paths(chunks: DataFrame, language: str = "python") -> DataFrame:
    """chunks (file, name, chunk_type, start_line, end_line) with name_path: module, enclosing classes from the outermost in, name."""
    keys = ["file", "name", "start_line", "end_line"]
    found = containing(chunks.select(*keys), chunks.where("lower(chunk_type) = 'class'").select(*keys), "file", "start_line", "end_line")
    outer = found.groupBy("inner").agg(F.sort_array(F.collect_list(F.struct((F.col("outer.start_line") - F.col("outer.end_line")).alias("o"), F.col("outer.name").alias("n")))).alias("__o")).select("inner.*", "__o")
    x = chunks.join(outer, keys, "left")
    middle = F.coalesce(F.transform("__o", lambda o: o["n"]), F.array().cast("array<string>"))
    return x.withColumn("name_path", F.array_join(F.concat(F.array(module_path(F.col("file"), language)), middle, F.array("name")), ".")).drop("__o")


def python_units(source: str | None, path: str = "") -> list[dict]:
    """Functions, methods and classes of Python source with what is known of them; broken source has none."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    lines, out = (source or "").split("\n"), []
    imported = {a.asname or a.name.split(".")[0] for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}
    choice = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension, ast.match_case)

    def visit(node, inside: bool):
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(n, ast.ClassDef)
                below = list(ast.walk(n))
                calls = [c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in below if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))]
                decisions = sum(isinstance(x, choice) for x in below) + sum(len(x.values) - 1 for x in below if isinstance(x, ast.BoolOp))
                args = [] if is_class else [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]
                out.append({
                    "name": n.name, "kind": "class" if is_class else "method" if inside else "function", "start_line": n.lineno, "end_line": n.end_lineno,
                    "signature": "" if is_class else f"{n.name}({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else ""),
                    "returns": "" if is_class or not n.returns else ast.unparse(n.returns), "params": [a.arg for a in args],
                    "decorators": [ast.unparse(d) for d in n.decorator_list], "docstring": ast.get_docstring(n) or "", "complexity": 1 + decisions,
                    "lines": n.end_lineno - n.lineno + 1, "calls": list(dict.fromkeys(calls)), "uses": sorted({x.id for x in below if isinstance(x, ast.Name)} & imported),
                    "source": "\n".join(lines[n.lineno - 1 : n.end_lineno]),
                })
                visit(n, is_class)
            else:
                visit(n, inside)

    visit(tree, False)
    return out


def _windows(text: str, size: int) -> list[tuple[int, int, str]]:
    """fixed_chunks for one text: (first line, last line, body)."""
    lines, out = text.split("\n"), []
    per = max(1, int(size / max(len(text) / len(lines), 0.001)))
    for i in range(0, len(lines), max(1, per - max(1, per // 10))):
        part = lines[i : i + per]
        if out and len("\n".join(part).strip()) < 50:
            a, _, body = out[-1]
            out[-1] = (a, i + len(part), "\n".join([body, *part]))
            break
        out.append((i + 1, i + len(part), "\n".join(part)))
    return out


def python_chunks(source: str | None, size: int = 2000) -> list[dict]:
    """Chunks (name, kind, start_line, end_line, source) of Python source: functions of any depth, then classes. A unit of more than size characters is cut in windows of lines, a class into its methods first; so is a source that is broken."""
    units = python_units(source)
    fixed = lambda text: [{"name": f"chunk_{k}", "kind": "fallback_fixed", "start_line": a, "end_line": b, "source": body} for k, (a, b, body) in enumerate(_windows(text, size))]
    short = lambda u: [{k: u[k] for k in ("name", "kind", "start_line", "end_line", "source")}] if len(u["source"]) <= size else fixed(u["source"])
    if not (source or "").strip():
        return []
    try:
        ast.parse(source)
    except (SyntaxError, ValueError):
        return fixed(source)
    out = [c for u in units if u["kind"] != "class" for c in short(u)]
    for u in (u for u in units if u["kind"] == "class"):
        methods = [m for m in units if m["kind"] == "method" and u["start_line"] < m["start_line"] and m["end_line"] <= u["end_line"]]
        out += [c for m in methods for c in short(m)] if len(u["source"]) > size and methods else short(u)
    return out


def call_contexts(source: str | None) -> list[dict]:
    """Calls of each function, method and class of Python source: name, line, scope, whether under a condition, a loop or a try, and the number of arguments."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    under = {"is_conditional": (ast.If, ast.IfExp, ast.Match), "is_loop": (ast.For, ast.AsyncFor, ast.While), "is_try": (ast.Try, ast.TryStar)}
    out = []

    def visit(node, flags: frozenset, scopes: tuple) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
                name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr
                for kind, scope in scopes:
                    out.append({"scope_type": kind, "scope_name": scope, "call_name": name, "line": n.lineno, **{k: k in flags for k in under}, "arguments": len(n.args) + len(n.keywords)})
            inner = scopes
            if isinstance(n, ast.ClassDef):
                inner = (*scopes, ("class", n.name))
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = (*scopes, ("method" if isinstance(node, ast.ClassDef) else "function", n.name))
            visit(n, flags | {k for k, kinds in under.items() if isinstance(n, kinds)}, inner)

    visit(tree, frozenset(), ())
    return out


_TS_UNIT = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:(async\s+)?function\s*(?:\*\s*)?(\w+)\s*\(([^)]*)\)(?:\s*:\s*([\w<>\[\]. |]+))?|(class|interface)\s+(\w+))", re.M)
_TS_IMPORT = re.compile(r"import\s+(?:type\s+)?(?:(\w+)\s*,?\s*)?(?:\{([^}]*)\}|\*\s+as\s+(\w+))?\s*from\s*['\"]([^'\"]+)['\"]")
_TS_AGAIN = re.compile(r"export\s+(type\s+)?(?:\*(?:\s+as\s+(\w+))?|\{([^}]*)\})\s+from\s*['\"]([^'\"]+)['\"]")


def _ts_parameter(text: str) -> dict:
    """name, type, optional and default of a parameter as written."""
    declared, _, default = text.partition("=")
    name, _, kind = declared.partition(":")
    return {"name": name.strip(" ?."), "type": kind.strip() or None, "optional": name.strip().endswith("?") or bool(default), "default": default.strip() or None}


def typescript_units(source: str | None) -> dict:
    """Units, imports and re-exports of TypeScript or JavaScript, by patterns."""
    s = source or ""
    units = [{"name": m[2] or m[6], "kind": m[5] or "function", "start_line": s.count("\n", 0, m.start(2) if m[2] else m.start(6)) + 1, "params": [_ts_parameter(p) for p in split_types(m[3] or "")], "returns": (m[4] or "").strip(), "async": bool(m[1]), "generator": bool(re.search(r"function\s*\*", m[0]))} for m in _TS_UNIT.finditer(s)]
    imports = []
    for default, named, space, src in _TS_IMPORT.findall(s):
        imports += [f"{src}.{n.split(' as ')[0].strip().removeprefix('type ')}" for n in named.split(",") if n.strip()]
        imports += [src] if default or space else []
    again = []
    for kind, star, named, src in _TS_AGAIN.findall(s):
        for n in named.split(",") if named else ["*"]:
            original, _, symbol = n.strip().partition(" as ")
            if original:
                again.append({"symbol": star or symbol or original, "original": original if symbol else None, "source": src, "is_type": bool(kind)})
    return {"units": units, "imports": imports, "re_exports": again}


def split_types(text: str) -> list[str]:
    """A parameter list cut at commas outside brackets."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()] if part.strip() else out


def hover_types(signature: str | None) -> dict:
    """Return type and parameter types of a hover text such as 'def f(a: int, b: dict[str, int] = {}) -> bool'."""
    m = re.search(r"\((.*)\)\s*(?:->\s*([^:]+))?", signature or "", re.S)
    if not m:
        return {"returns": None, "params": {}}
    params = {}
    for p in split_types(m[1]):
        name, colon, kind = p.partition(":")
        if colon:
            params[name.strip().lstrip("*")] = kind.split("=")[0].strip()
    return {"returns": (m[2] or "").strip() or None, "params": params}


def mock_embedding(text: str | None, dim: int = 768) -> list[float]:
    """A unit vector that depends on the text alone; the zero vector for blank text. A stand-in where no model is at hand."""
    if not (text or "").strip():
        return [0.0] * dim
    seed = int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "little")
    v = np.random.default_rng(seed).uniform(-1, 1, dim)
    return (v / np.linalg.norm(v)).astype(float).tolist()


# Keywords by which an indexing error is classed, the first class that matches.
ERROR_WORDS = {"timeout": "timeout|timed out", "memory": "out of memory|memoryerror|oom", "encoding": "decode|encoding|utf-8", "parse": "syntax|parse", "database": "database|sql|connection"}


def error_class(message: Column) -> Column:
    out, low = None, F.lower(F.coalesce(message, F.lit("")))
    for name, words in ERROR_WORDS.items():
        out = (F.when if out is None else out.when)(low.rlike(words), name)
    return out.otherwise("unknown")


def changed(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files (path, modified, content) that are new, or newer than their last indexing and of other content."""
    x = files.withColumn("hash", F.md5("content")).join(indexed.select("path", "indexed_at", F.col("hash").alias("__h")), "path", "left")
    return x.where(F.col("indexed_at").isNull() | ((F.col("modified") > F.col("indexed_at")) & ~F.col("hash").eqNullSafe(F.col("__h")))).drop("__h", "indexed_at")
