"""Project and batch scans; ignore files against git itself where it is there."""
from __future__ import annotations

import os
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from lodeweave.sources import files as S

LINES = [
    "# notes", "", "   ", "*.log", "!keep.log", "build/", "/root.md", "docs/*.md", "**/gen/**", "a/**/z.py", "x[0-9]y", "n[!a-c]m", "q?r", "sub/dir/", "/only/here", "trail  ", "\\#odd", "\\!not", "we.ird+(x)",
    "deep/**", "**/any", "f*o*o", "[]", "tail\\ ", "!sub/dir/back.py", "!a/b/z.py", "*.tmp/", "é*",
]
PATHS = [
    "m.log", "keep.log", "d/keep.log", "d/m.log", "build/x", "d/build/x", "build", "rebuild/x", "root.md", "d/root.md", "docs/a.md", "docs/b/a.md", "d/docs/a.md", "p/gen/q", "gen/q", "p/gen", "a/z.py", "a/b/z.py", "a/b/c/z.py",
    "b/a/z.py", "x5y", "d/x5y/e", "xy", "x55y", "nam", "nbm", "ndm", "n/m", "qxr", "q/r", "sub/dir/f", "e/sub/dir/f", "sub/dir", "only/here", "only/here/x", "d/only/here", "trail", "trail  ", "#odd", "!not", "we.ird+(x)",
    "weXird+(x)", "deep/x", "deep/x/y", "d/deep/x", "any", "d/e/any/f", "foo", "fxoxo", "f/oo", "[]", "tail ", "tail", "x.tmp", "x.tmp/y", "été", "d/étage/x", "notes", "# notes",
]


def rules(spark, lines, paths):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r["path"] for r in df.where(S.ignored(F.col("path"), lines)).collect()}


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
def test_ignore_rules_equal_git(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("\n".join(LINES) + "\n")
    found = subprocess.run(["git", "-C", str(tmp_path), "-c", "core.quotepath=off", "check-ignore", "--no-index", "--stdin", "-z"], input="\0".join(PATHS).encode(), capture_output=True).stdout.decode()
    assert rules(spark, LINES, PATHS) == set(found.split("\0")) - {""}


def test_last_rule_decides(spark):
    assert rules(spark, ["*.md", "!m.md"], ["m.md", "d/m.md", "n.md"]) == {"n.md"}
    assert rules(spark, ["!m.md", "*.md"], ["m.md"]) == {"m.md"}
    assert rules(spark, ["a/b"], ["a/b", "a/b/c", "x/a/b", "a/bc"]) == {"a/b", "a/b/c"}
    assert rules(spark, [], ["a"]) == set()


def test_batch_scan_by_parts_and_patterns(spark, tmp_path):
    kept = ["src/a.ts", "src/xgit/a.ts", "src/a.d.ts", "lib/test_a.py", "lib/distant/a.ts", "src/spec.ts", "contest.ts"]
    gone = [".git/a.ts", "src/dist/a.ts", "a/node_modules/b/a.ts", "src/a.spec.ts", "src/a.test.py", "x/__tests__/a.ts", "vitest.config.ts", "src/vitest.setup.ts", "a.TS", "a.tsx", "build/a.py"]
    for p in kept + gone:
        at = tmp_path / "r" / p
        os.makedirs(at.parent, exist_ok=True)
        at.write_text("x")
    got = [r["path"] for r in S.scan_batch(spark, str(tmp_path / "r"), [".ts", ".py"]).collect()]
    assert got == sorted(kept)
    both = {r["path"] for r in S.scan_batch(spark, str(tmp_path / "r"), [".ts"], excluded=[".git"], tests=True).collect()}
    assert {"src/a.spec.ts", "vitest.config.ts", "src/dist/a.ts", "src/xgit/a.ts"} <= both and ".git/a.ts" not in both


def test_project_scan_reads_the_ignore_file_and_is_not_cut(spark, tmp_path):
    for p, text in {"a.py": b"x = 1", "m.md": b"# m", "n.md": b"# n", "b/c.go": b"package c", ".venv/a.py": b"", "bad.py": b"\xff\xfe", "a.txt": b"x", ".gitignore": b"*.md\n!m.md\n"}.items():
        at = tmp_path / "r" / p
        os.makedirs(at.parent, exist_ok=True)
        at.write_bytes(text)
    found = S.scan_project(spark, str(tmp_path / "r"))
    assert [(r["path"], r["language"]) for r in found.collect()] == [("a.py", "python"), ("b/c.go", "go"), ("m.md", "markdown")]
    assert S.scan_project(spark, str(tmp_path / "r"), most=3).count() == 3 and S.scan_project(spark, str(tmp_path / "r"), ["b/"], most=None).count() == 2
    with pytest.raises(ValueError):
        S.scan_project(spark, str(tmp_path / "r"), most=2)


def test_no_limit_in_the_scan_of_a_table(spark, sf_dir):
    from lodeweave import catalog

    plan = catalog.queries()["s4_project_scan"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan
