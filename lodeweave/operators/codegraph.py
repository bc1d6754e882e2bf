"""A graph of code: nodes from chunks, calls, imports, re-exports and containment resolved by joins.

Names are resolved against counts and smallest matches of each name, found once a name, so a name that stands in very
many chunks and calls makes no pairs. Clues about paths are looked up too: files are spelt out by the starts of their
paths that end where a part ends, and by the words in them, so that a symbol of many files meets many clues by equality
and not each file each clue. Where a rule takes the first of several chunks, that is the one of the smallest id."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

# Node types by chunk type; other kinds of chunks make no node.
NODE_TYPES = {
    "class": "Class", "interface": "Class", "function": "Function", "method": "Function", "arrow_function": "Function",
    "async_function": "Function", "barrel": "Module", "config_module": "Config",
}
# Names that the language gives, never resolved to a chunk.
BUILTINS = [
    "abs", "all", "any", "ascii", "bin", "bool", "bytearray", "bytes", "callable", "chr", "classmethod", "compile", "complex", "delattr",
    "dict", "dir", "divmod", "enumerate", "eval", "exec", "filter", "float", "format", "frozenset", "getattr", "globals", "hasattr",
    "hash", "help", "hex", "id", "input", "int", "isinstance", "issubclass", "iter", "len", "list", "locals", "map", "max", "memoryview",
    "min", "next", "object", "oct", "open", "ord", "pow", "print", "property", "range", "repr", "reversed", "round", "set", "setattr",
    "slice", "sorted", "staticmethod", "str", "sum", "super", "tuple", "type", "vars", "zip", "__import__", "Exception", "ValueError",
    "TypeError", "KeyError", "IndexError", "AttributeError", "ImportError", "RuntimeError", "NotImplementedError", "StopIteration",
    "AssertionError", "KeyboardInterrupt", "SystemExit", "None", "True", "False", "Ellipsis", "NotImplemented",
]
# Starts of imports from outside, and path parts that say nothing about a package.
OUTSIDE = ["vue.", "pinia.", "uuid.", "axios.", "lodash.", "moment.", "react.", "angular.", "@vue/", "@angular/", "@react/"]
PLAIN_PARTS = ["", "..", ".", "src", "dist"]
# What is tried behind an imported path, in this order.
ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", ""]


def graph_nodes(chunks: DataFrame) -> DataFrame:
    """(node_id, node_type, label, file, parent_package, parent_module, parent_folder) of chunks (id, file, name, chunk_type); kinds without a node type and anonymous ones are left out.

    The package is the part behind 'packages', the module the part behind 'src', else the second behind 'packages', else the first."""
    table = F.create_map(*[F.lit(x) for p in NODE_TYPES.items() for x in p])
    kind = F.try_element_at(table, F.col("chunk_type"))
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat("chunk_type", F.lit("_"), F.left(F.col("id").cast("string"), F.lit(8))))
    label = F.when(F.length(name) > 100, F.concat(F.left(name, F.lit(97)), F.lit("..."))).otherwise(name)
    parts = F.split("file", "/")
    n, src, pkg = F.size(parts), F.array_position(parts, "src"), F.array_position(parts, "packages")
    part = lambda i: F.get(parts, i.cast("int"))
    module = F.when(src > 0, F.when(src < n, part(src))).when((pkg > 0) & (pkg + 1 < n), part(pkg + 1)).when(n > 1, part(F.lit(0)))
    folder = F.when(F.col("chunk_type").isin("class", "function", "method"), F.nullif(F.array_join(F.slice(parts, F.lit(1), n - 1), "/"), F.lit("")))
    kept = chunks.where(kind.isNotNull() & ~F.coalesce(F.col("name"), F.lit("")).startswith("anonymous"))
    return kept.select(F.col("id").alias("node_id"), kind.alias("node_type"), label.alias("label"), "file", F.when((pkg > 0) & (pkg < n), part(pkg)).alias("parent_package"), module.alias("parent_module"), folder.alias("parent_folder"))


def _tails(chunks: DataFrame) -> DataFrame:
    """(key, dst, file, name_path): each chunk under its name path and all ends of it that begin behind a dot."""
    path = F.split("name_path", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, i, F.size(path)), "."))
    return chunks.where(F.coalesce("name_path", F.lit("")) != "").select(F.explode(F.array_distinct(tails)).alias("key"), F.col("id").alias("dst"), "file", "name_path")


def resolve_calls(calls: DataFrame, chunks: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(src, dst, callee) for calls (id, file, callee) of names that the language doesn't give. chunks: id, file, name, name_path; imports: id, target.

    The only chunk whose name path is the callee or ends in it; of several the only one in the caller's file, else the
    one of the smallest name path; where there is none the chunk of that name in the same file, else any of that name
    if an import of the caller ends in it. A chunk that calls itself has an edge to itself."""
    keys = cut(_tails(chunks))
    all_ = cut(keys.groupBy(F.col("key").alias("callee")).agg(F.count("*").alias("n"), F.min_by("dst", F.struct("name_path", "dst")).alias("least")))
    near = cut(keys.groupBy(F.col("key").alias("callee"), "file").agg(F.count("*").alias("m"), F.min("dst").alias("own")))
    x = cut(calls.where(~F.col("callee").isin(*BUILTINS)).join(all_, "callee", "left").join(near, ["callee", "file"], "left"))
    found = x.where("n is not null").select("id", F.when((F.col("n") > 1) & (F.col("m") == 1), F.col("own")).otherwise(F.col("least")).alias("dst"), "callee")
    rest = x.where("n is null").select("id", "file", "callee")
    named = chunks.groupBy(F.col("name").alias("callee"), "file").agg(F.min("id").alias("here"))
    anywhere = chunks.groupBy(F.col("name").alias("callee")).agg(F.min("id").alias("far"))
    rest = rest.join(named, ["callee", "file"], "left").join(anywhere, "callee", "left")
    if imports is None:
        rest = rest.withColumn("told", F.lit(False))
    else:
        ends = rest.where("here is null and far is not null").select("id", "callee").join(imports.select("id", "target"), "id").where(F.endswith("target", "callee")).select("id", "callee").distinct().withColumn("told", F.lit(True))
        rest = rest.join(ends, ["id", "callee"], "left")
    dst = F.coalesce("here", F.when(F.col("told"), F.col("far")))
    return found.unionByName(rest.select("id", dst.alias("dst"), "callee").where("dst is not null")).select(F.col("id").alias("src"), "dst", "callee")


def inside(target: Column, internal: tuple[str, ...] = ("../", "./")) -> Column:
    """Whether an import is of the repository itself: it starts as one of internal, or is a path that no known package starts."""
    out = F.contains(target, F.lit("/"))
    for p in OUTSIDE:
        out = out & ~target.startswith(p)
    for p in internal:
        out = out | target.startswith(p)
    return out


def package_hint(target: Column) -> Column:
    """The last part of a path that says something, up to its first dot; null for no path."""
    parts = F.filter(F.reverse(F.split(target, "/")), lambda p: ~p.isin(*PLAIN_PARTS))
    return F.when(F.contains(target, F.lit("/")), F.split_part(F.get(parts, F.lit(0)), F.lit("."), F.lit(1)))


def _lengths(asked: DataFrame) -> DataFrame:
    """(symbol, lengths): the different lengths of a symbol's clues, which paths bound, however many clues there are."""
    return asked.groupBy("symbol").agg(F.collect_set(F.length("clue")).alias("lengths"))


def first_below(asked: DataFrame, places: DataFrame) -> DataFrame:
    """(symbol, clue, dst): of the places (symbol, file, dst) of a symbol whose file starts as a clue (symbol, clue), the smallest dst.

    A file is spelt out by its starts of the lengths that are asked for, so clues and files meet by equality."""
    starts = places.join(_lengths(asked), "symbol").select("symbol", "dst", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("file")), lambda n: F.substring("file", F.lit(1), n))).alias("clue"))
    return asked.distinct().join(starts.groupBy("symbol", "clue").agg(F.min("dst").alias("dst")), ["symbol", "clue"])


#: Clues of a symbol up to which each is held against each of its files.
FEW_CLUES = 64


def first_holding(asked: DataFrame, places: DataFrame, few: int = FEW_CLUES) -> DataFrame:
    """(symbol, clue, dst): as first_below, for files that hold a clue anywhere. A symbol of many clues has its files spelt out by what stands in them at the lengths that are asked for."""
    asked = asked.distinct()
    many = asked.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") > few).select("symbol")
    tried = asked.join(many, "symbol", "left_anti").join(places, "symbol").where(F.contains("file", "clue")).select("symbol", "clue", "dst")
    parts = lambda n: F.when(n <= F.length("file"), F.transform(F.sequence(F.lit(1), F.length("file") - n + 1), lambda i: F.substring("file", i, n)))
    spelt = places.join(_lengths(asked.join(many, "symbol", "left_semi")), "symbol").select("symbol", "dst", F.explode(F.array_distinct(F.flatten(F.array_compact(F.transform("lengths", parts))))).alias("clue"))
    spelt = asked.join(spelt.groupBy("symbol", "clue").agg(F.min("dst").alias("dst")), ["symbol", "clue"])
    return tried.unionByName(spelt).groupBy("symbol", "clue").agg(F.min("dst").alias("dst"))


def resolve_imports(imports: DataFrame, chunks: DataFrame, internal: tuple[str, ...] = ("../", "./")) -> DataFrame:
    """(src, dst, target) for imports (id, file, target) from inside. chunks: id, file, name, name_path.

    The symbol is what follows the last dot. The only chunk whose name path is the symbol or ends in it; of several the
    first whose file holds the package hint, else the first; where there is none the only chunk of that name, else the
    first of that name in a folder that starts as the importing file's, else the first."""
    symbol = F.trim(F.substring_index("target", ".", -1))
    x = imports.where(inside(F.col("target"), internal) & F.contains(F.col("target"), F.lit("."))).select("id", "target", symbol.alias("symbol"), package_hint(F.col("target")).alias("hint"), F.regexp_replace("file", "/?[^/]*$", "").alias("folder"))
    x = cut(x.where("symbol <> ''"))

    def first_of(keys: DataFrame, clue: str, look) -> DataFrame:
        """(symbol, clue, n, least, best): matches of a symbol, the first, and the first in a file that a clue finds."""
        places = cut(keys.groupBy("symbol", "file").agg(F.count("*").alias("k"), F.min("dst").alias("dst")))
        whole = places.groupBy("symbol").agg(F.sum("k").alias("n"), F.min("dst").alias("least"))
        asked = x.select("symbol", clue).distinct()
        told = look(asked.select("symbol", F.col(clue).alias("clue")).where("clue is not null"), places).withColumnsRenamed({"clue": clue, "dst": "best"})
        return asked.join(whole, "symbol", "left").join(told, ["symbol", clue], "left")

    by_path = first_of(_tails(chunks).select(F.col("key").alias("symbol"), "dst", "file"), "hint", lambda asked, places: first_holding(asked.where("clue <> ''"), places))
    by_name = first_of(chunks.select(F.col("name").alias("symbol"), F.col("id").alias("dst"), "file"), "folder", first_below)
    pick = lambda t: F.when(F.col(f"{t}.n") == 1, F.col(f"{t}.least")).otherwise(F.coalesce(f"{t}.best", f"{t}.least"))
    same = lambda t, clue: (F.col("i.symbol") == F.col(f"{t}.symbol")) & F.col(f"i.{clue}").eqNullSafe(F.col(f"{t}.{clue}"))
    out = x.alias("i").join(by_path.alias("p"), same("p", "hint"), "left").join(by_name.alias("m"), same("m", "folder"), "left")
    return out.select(F.col("i.id").alias("src"), F.coalesce(pick("p"), pick("m")).alias("dst"), "i.target").where("dst is not null")


def joined_path(file: Column, target: Column, alias: str = "/app/src/") -> Column:
    """The path that a relative import means in a file's folder, '.' and '..' worked out; '@/' stands for alias; null for packages."""
    folder = F.regexp_replace(file, "/?[^/]*$", "")
    steps = F.split(F.when(folder == "", target).otherwise(F.concat(folder, F.lit("/"), target)), "/")
    # '..' after '..' goes on climbing
    up = lambda a: (F.size(a) > 0) & (F.element_at(a, F.greatest(F.lit(1), F.size(a))) != "..")
    walk = lambda a, s: F.when((s == "") | (s == "."), a).when((s == "..") & up(a), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(s)))
    plain = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/")
    plain = F.when(F.startswith(file, F.lit("/")), F.concat(F.lit("/"), plain)).otherwise(plain)
    return F.when(target.startswith("@/"), F.concat(F.lit(alias), F.substr(target, F.lit(3)))).when(target.startswith("."), plain).when(target.startswith("@"), target)


def reexport_edges(again: DataFrame, chunks: DataFrame) -> DataFrame:
    """(src, dst, symbol) for re-exports (id, file, source, symbol): the first chunk of that name in a file whose path starts as the source's; '*' is left out."""
    x = cut(again.where("symbol <> '*'").select("id", "symbol", joined_path(F.col("file"), F.col("source")).alias("prefix")))
    places = chunks.groupBy(F.col("name").alias("symbol"), "file").agg(F.min("id").alias("dst"))
    asked = x.select("symbol", F.col("prefix").alias("clue")).where("prefix is not null")
    found = first_below(asked, places).withColumnRenamed("clue", "prefix")
    return x.join(found, ["symbol", "prefix"]).select(F.col("id").alias("src"), "dst", "symbol")


def contains_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst, level): packages hold the modules that name them, modules the files, files their classes and functions, for nodes (node_id, node_type, label, file, parent_package, parent_module)."""
    of = lambda kind, key: nodes.where(F.col("node_type") == kind).groupBy(F.col(key).alias("k")).agg(F.min("node_id").alias("src"))
    steps = (("package_to_module", ["Module"], "parent_package", of("Package", "label")), ("module_to_file", ["File"], "parent_module", of("Module", "label")), ("file_to_entity", ["Class", "Function", "Method"], "file", of("File", "file")))
    out = None
    for level, kinds, key, parents in steps:
        part = nodes.where(F.col("node_type").isin(*kinds)).join(parents, F.col(key) == F.col("k")).select("src", F.col("node_id").alias("dst"), F.lit(level).alias("level"))
        out = part if out is None else out.unionByName(part)
    return out


def module_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, target, dst) between files: what the imports (file, target) of a file, without their symbols, lead to: the first ending that makes a path of files (file)."""
    path = F.when(F.contains(F.col("target"), F.lit(".")), F.regexp_extract("target", r"(?s)^(.*)\.", 1)).otherwise(F.col("target"))
    x = imports.select("file", path.alias("target")).distinct()
    x = x.withColumn("base", joined_path(F.col("file"), F.col("target"))).where("base is not null")
    tries = x.select("file", "target", F.posexplode(F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat("base", e))).alias("n", "path"))
    hit = tries.join(files.select(F.col("file").alias("path")).distinct(), "path", "left_semi")
    return hit.groupBy("file", "target").agg(F.min_by("path", "n").alias("dst")).select(F.col("file").alias("src"), "target", "dst")


def isolation(edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row: total_files, total_edges, isolated_files, isolation_rate of a module graph; files: file."""
    every = files.select("file").distinct()
    ends = edges.select(F.col("src").alias("file")).unionByName(edges.select(F.col("dst").alias("file"))).distinct().withColumn("met", F.lit(1))
    out = every.join(ends, "file", "left").agg(F.count("*").alias("total_files"), F.count_if(F.col("met").isNull()).alias("isolated_files"))
    out = out.crossJoin(edges.agg(F.count("*").alias("total_edges")))
    return out.withColumn("isolation_rate", F.coalesce(F.try_divide("isolated_files", "total_files"), F.lit(0.0)))
