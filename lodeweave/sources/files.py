"""File sources: project scans, transcripts, uploads; and a bulk generator."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

# Suffixes of project files and their languages.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".go": "go", ".rs": "rust",
    ".java": "java", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp", ".rb": "ruby", ".php": "php",
    ".cs": "csharp", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".md": "markdown",
}
# Names of lock files, which are never indexed.
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "composer.lock", "Gemfile.lock", "Cargo.lock", "go.sum", "uv.lock", "bun.lockb", "flake.lock"]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])
    return F.try_element_at(table, suffix(path))


def _glob(pattern: str) -> str:
    """A pattern of an ignore file, without slashes at its ends, as a regular expression of a path."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "([^/]+/)*", i + 3
            continue
        if pattern[i:] == "**" and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + ".+", i + 2
            continue
        if c == "*":
            while pattern.startswith("*", i + 1):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" not in pattern[i + 2 :]:
            return "(?!)"  # a class that never ends matches nothing
        elif c == "[":
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            negated = body[0] in "!^"
            body = body[1:] if negated else body
            out += ("[^/" if negated else "[") + "".join(f"\\{x}" if x in "[]&^\\" else x for x in body) + "]"
            i = end
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out += c if c.isalnum() or c in "_/" or ord(c) > 127 else f"\\{c}"
        i += 1
    return out


def ignore_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """(regular expression, whether it ignores) for the lines of an ignore file, comments and blank lines left out.

    A pattern with a slash at its start or inside stands for a path from the root, any other for a name at any depth; one
    that ends with a slash for folders only. What lies in a folder that matches, matches."""
    rules = []
    for line in lines:
        line = line.rstrip("\r\n")
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        keeps = line.startswith("!")
        body = line[1:] if keeps else line
        if not body or line.startswith("#") or not body.strip("/"):
            continue
        folder, rooted = body.endswith("/"), "/" in body.rstrip("/")
        rules.append((("^" if rooted else "^([^/]+/)*") + _glob(body.strip("/")) + ("/.+$" if folder else "(/.+)?$"), not keeps))
    return rules


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path is covered by the lines of an ignore file: the last line that matches it decides, one with ! takes it back in."""
    out = F.lit(False)
    for rule, ignores in ignore_rules(patterns):
        out = F.when(path.rlike(rule), F.lit(ignores)).otherwise(out)
    return out


def ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """The lines of root's .gitignore; none without one. It is opened as a file, since readers of tables pass over names that begin with a dot."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()


def project_files(files: DataFrame, ignore: list[str]) -> DataFrame:
    """(path, content, language, modified) of files (path, content as binary, modified) that belong to a project: known suffixes, no hidden or ignored parts, valid UTF-8."""
    p = F.col("path")
    kept = files.where(p.rlike(r"^[^.][^/]*(/[^.][^/]*)*$") & language(p).isNotNull() & ~ignored(p, ignore) & F.is_valid_utf8(F.col("content").cast("string")))
    return kept.select("path", F.col("content").cast("string").alias("content"), language(p).alias("language"), "modified")


def scan_project(spark: SparkSession, root: str, ignore: list[str] | None = None, most: int | None = 10_000) -> DataFrame:
    """project_files of a folder, by path; more than ``most`` of them are an error. What is ignored stands in its .gitignore and in ignore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.substring_index(F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/"), root.rstrip("/") + "/", -1)
    found = project_files(files.select(rel.alias("path"), "content", F.col("modificationTime").alias("modified")), [*ignore_lines(spark, root), *(ignore or [])])
    if most is not None and not found.select("path").offset(most).limit(1).isEmpty():
        raise ValueError(f"more than {most} files; scan subdirectories separately")
    return found.orderBy("path")


# Folders that are never indexed, and parts of the paths of tests.
EXCLUDED = ["node_modules", ".git", ".svn", ".hg", "__pycache__", "dist", "build", ".next"]
TESTS = ["__tests__", ".spec.", ".test.", "vitest.config", "vitest.setup"]


def batch_files(files: DataFrame, suffixes: list[str], excluded: list[str] | None = None, tests: bool = False) -> DataFrame:
    """files (path, ...) to index, sorted: given suffixes, no part of the path an excluded name, and unless asked for no tests."""
    p, parts = F.col("path"), F.array(*map(F.lit, EXCLUDED if excluded is None else excluded)).cast("array<string>")
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | p.endswith(s)
    keep = keep & ~F.arrays_overlap(F.split(p, "/"), parts)
    for t in [] if tests else TESTS:
        keep = keep & ~p.contains(t)
    return files.where(keep).orderBy("path")


def scan_batch(spark: SparkSession, root: str, suffixes: list[str], excluded: list[str] | None = None, tests: bool = False) -> DataFrame:
    """batch_files of a folder (path below it, length)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.substring_index(F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/"), root.rstrip("/") + "/", -1)
    return batch_files(files.select(rel.alias("path"), "length"), suffixes, excluded, tests)


def read_transcripts(spark: SparkSession, root: str, settled_before: str | None = None) -> DataFrame:
    """transcript_lines of the files under root; those changed at or after a time (a timestamp as text) are still being written and left out."""
    raw = spark.read.text(root)
    meta = raw.metadataColumn("_metadata")
    raw = raw.select("value", meta["file_path"].alias("file"), F.monotonically_increasing_id().alias("line"), meta["file_modification_time"].alias("modified"))
    return transcript_lines(raw if settled_before is None else raw.where(F.col("modified") < F.lit(settled_before).cast("timestamp")))


def transcript_lines(lines: DataFrame) -> DataFrame:
    """(session, line, role, text, tool_result, timestamp) of JSON lines (file, line, value); broken lines and agent files are left out.

    A message's content is a text or a list of parts; a list with a tool_result is no user turn."""
    raw = lines.where(~F.col("file").rlike(r"(^|/)agent-[^/]*$"))
    v = F.try_parse_json("value")
    get = lambda path, t="string": F.try_variant_get(v, path, t)
    parts = F.from_json(F.get_json_object("value", "$.message.content"), "array<struct<type:string,text:string,thinking:string>>")
    part = lambda p: F.when(p["type"] == "text", p["text"]).when((p["type"] == "thinking") & (p["thinking"] != ""), F.concat(F.lit("[Thinking: "), F.left(p["thinking"], F.lit(200)), F.lit("...]")))
    joined = F.array_join(F.array_compact(F.transform(parts, part)), "\n")
    content = F.get_json_object("value", "$.message.content")
    is_list = F.schema_of_variant(F.try_variant_get(v, "$.message.content", "variant")).startswith("ARRAY")
    tool = is_list & F.exists(parts, lambda p: p["type"] == "tool_result")
    good = raw.where(v.isNotNull())
    return good.select(F.regexp_extract("file", r"([^/]+)\.[^./]*$", 1).alias("session"), "line", get("$.message.role").alias("role"), F.when(is_list, joined).otherwise(content).alias("text"), F.coalesce(tool, F.lit(False)).alias("tool_result"), get("$.timestamp").alias("timestamp"))


def uploaded(spark: SparkSession, files: list[tuple[str | None, str | None]]) -> DataFrame:
    return spark.createDataFrame(files, "path string, content string")


def admit(files: DataFrame, most_bytes: int = 500_000) -> DataFrame:
    """files with normalised path and reject, the reason why a file is not taken (null: it is)."""
    p, c = F.col("path"), F.col("content")
    name = F.substring_index(F.regexp_replace(F.coalesce(p, F.lit("")), r"\\", "/"), "/", -1)
    why = (
        F.when(p.isNull() | (p == ""), "missing path").when(c.isNull() | (c == ""), "missing content").when(~X.safe_path(p), "unsafe path")
        .when(name.isin(*LOCK_FILES), "lock file").when(X.binary_like(c), "binary").when(F.octet_length(c) > most_bytes, "too large")
    )
    return files.withColumn("reject", why).withColumn("path", X.normalize_path(p))


def generated_events(spark: SparkSession, n: int, days: int = 90, seed: int = 42) -> DataFrame:
    """n synthetic events over some days, the same for the same seed."""
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(len(names))) + 1).cast("int"))
    second = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(days * 86_400))
    ids = spark.range(n)
    return ids.select("id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=second.cast("double"))).alias("timestamp"), pick(1, "log", "metric", "trace", "audit").alias("type"), pick(2, *[str(i) for i in range(1, 11)]).alias("tenant"))
