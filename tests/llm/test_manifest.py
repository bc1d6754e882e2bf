"""Vector codes, url filters and the Merkle manifest against plain versions, and their SQL on fixtures."""
from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import merkle, sql, urlfilter, vectorcodes

# --- vector codes ------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes by lists: rows of (vec_id, vector, label) in any order."""
    kept = [(i, [math.floor(max(-vectorcodes.MOST, min(vectorcodes.MOST, scale * x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), y) for i, v, y in kept]
    piece = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[piece(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(piece(v, p), books[p])[1]].append(piece(v, p))
            for j, xs in groups.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, sums = [], Counter()
    for i, v, y in kept:
        found = [nearest(piece(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), y))
        sums[y] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, sums[y], digest) for i, c, e, y in out), key=str)


def vector_rows():
    pick = np.random.default_rng(7)
    base = pick.normal(0, 0.2, (12, 16))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + pick.normal(0, 0.05, 16)], None if i % 7 == 0 else int(i % 3)) for i in range(120)]
    rows += [(200 + i, rows[5][1], 1) for i in range(90)]  # a vector that repeats
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 2), (None, rows[8][1], None), (-3, [-0.1] * 16, 9)]
    rows += [(300, None, 1), (301, [None] * 16, 1), (302, [math.nan] * 16, 1), (303, [0.0] * 15 + [math.inf], 1), (304, [-math.inf] + [0.0] * 15, 1)]
    return rows


def test_codes_equal_plain_lloyd(spark):
    rows = vector_rows()
    got = vectorcodes.compressed(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_codes(rows)


def test_codes_of_odd_vectors(spark):
    rows = [(1, [0.5, -0.25, 3.0], 1), (2, [], None), (3, [1.0] * 11, 2), (4, [3e38, -3e38], 1), (5, [2e4] * 11, 1)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({"row": F.lit("x"), "pos": F.lit(1), "weight": F.lit(2), "code": F.lit("c"), "ints": F.lit(0)})
    assert sorted((tuple(r) for r in vectorcodes.compressed(frame).collect()), key=str) == plain_codes(rows)
    few = [tuple(r) for r in vectorcodes.compressed(frame, parts=3, entries=2, rounds=2).collect()]
    assert sorted(few, key=str) == plain_codes(rows, parts=3, entries=2, rounds=2)
    assert vectorcodes.compressed(frame.limit(0)).collect() == []
    assert vectorcodes.compressed(frame.where("vec_id = 2").withColumn("embedding", F.lit(None).cast("array<float>"))).collect() == []
    with pytest.raises(ValueError):
        vectorcodes.compress(frame, entries=257)


def test_codes_round_trip_and_doubles(spark):
    rows = [(i, [i * 0.001 + j for j in range(8)], 0) for i in range(16)]
    made = vectorcodes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    for r in made.codes.select("vec_id", "error", made.decoded(F.col("code")).alias("x")).collect():
        assert r["error"] == 0 and r["x"] == [math.floor(4096 * x) for x in rows[r["vec_id"]][1]]


def test_codes_sql_on_the_fixture(spark):
    rows = [r for r in vector_rows() if r[0] is not None and r[0] != 5]
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}))
    assert sorted(con.execute(sql.OP11).fetchall(), key=str) == plain_codes(rows)


# --- url filters -------------------------------------------------------------


def link(href, more=""):
    return f'<html><head><LINK {more} rel="canonical" href="{href}"></head>'


PAGES = [
    (1, "http://a.example.net/fr/1", ""),
    (2, "http://a.EXAMPLE.net/en/1?x=1#y", None),
    (3, "https://x.example.com/de/9", "<p>"),
    (4, "https://x.example.com/defg", "<p>"),
    (5, "http://b.org/fr/", ""),
    (6, "http://borg/fr/", ""),
    (7, "net/fr", ""),
    (8, None, "x"),
    (9, "http://net", ""),
    (10, "http://free.test/a", link("http://bad.net/x")),
    (11, "https://free.test/a/?utm_source=q&ref=1#top", ""),
    (12, "http://other.test/dir/page", '<meta http-equiv="Refresh" content="0; URL=http://free.test/a">'),
    (13, "http://other.test/dir/b", link("page?ref=9")),
    (14, "http://saved.test/1", link("http://bad.net/y") + link("https://b.org/fr/good")),
    (15, "http://saved.test/2", link("//saved.test/1")),
    (16, "http://b.org/fr/z", link("http://bad.net/zz")),
    (17, "http://plain.test/1", "<!-- " + link("http://bad.net/q") + " --><script>var a = '" + link("http://bad.net/q") + "'</script>"),
    (18, "http://plain.test/2", link("mailto:x@bad.net") + link("#bad.net") + link("")),
    (19, "http://quote.test/1", "<link href='http://bad.net/k' rel='canonical'>"),
    (20, "http://quote.test/2", "<link href=http://quote.test/1 rel=canonical>"),
    (21, "http://amp.test/1", link("http://amp.test/2?a=1&amp;b=2")),
    (22, "http://amp.test/2?a=1&b=2", link("http://bad.net/amp")),
    (23, "http://x.example.com/de", ""),
    (24, "http://x.example.com/de/", ""),
    (25, "://h/p", ""),
    (26, "a\nb://h.Net/p\nq?z", ""),
    (27, "http://long.test/" + "y" * 200_000, link("http://bad.net/l")),
    (27, "http://long.test/" + "y" * 200_000, ""),
]
WANT = {
    1: ("a.example.net", "/fr/1", "net/", "block"), 2: ("a.example.net", "/en/1", "example.net/en/", "allow"), 3: ("x.example.com", "/de/9", "example.com/de/", "block"), 4: ("x.example.com", "/defg", None, "allow"),
    5: ("b.org", "/fr/", "org/fr/", "allow"), 6: ("borg", "/fr/", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("net", "", None, "allow"),
    10: ("free.test", "/a", None, "block"), 11: ("free.test", "/a/", None, "block"), 12: ("other.test", "/dir/page", None, "block"), 13: ("other.test", "/dir/b", None, "block"),
    14: ("saved.test", "/1", None, "allow"), 15: ("saved.test", "/2", None, "allow"), 16: ("b.org", "/fr/z", "org/fr/", "allow"), 17: ("plain.test", "/1", None, "allow"), 18: ("plain.test", "/2", None, "allow"),
    19: ("quote.test", "/1", None, "block"), 20: ("quote.test", "/2", None, "block"), 21: ("amp.test", "/1", None, "block"), 22: ("amp.test", "/2", None, "block"),
    23: ("x.example.com", "/de", None, "block"), 24: ("x.example.com", "/de/", "example.com/de/", "block"), 25: ("h", "/p", None, "allow"), 26: ("h.net", "/p\nq", "net/", "block"), 27: ("long.test", "/" + "y" * 200_000, None, "block"),
}


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_urls_follow_rules_and_aliases(spark):
    got = urlfilter.judged(pages(spark).withColumns({"node": F.lit(1), "host": F.lit("net"), "comp": F.lit(2), "r": F.lit(3)})).collect()
    assert len(got) == len(PAGES)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == WANT[r["page_id"]], r["page_id"]
    of = defaultdict(set)
    for r in got:
        of[r["alias_class"]].add(r["page_id"])
    assert {frozenset(v) for k, v in of.items() if k} >= {frozenset({10, 11, 12, 13}), frozenset({19, 20}), frozenset({21, 22}), frozenset({23, 24})}
    assert {14, 15} <= next(v for v in of.values() if 14 in v) and of[None] == {7, 8}


def test_urls_sql_on_the_fixture(spark):
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [p[0] for p in PAGES], "url": [p[1] for p in PAGES], "html": [p[2] for p in PAGES]}))
    want = con.execute(sql.OP12)
    names = [d[0] for d in want.description]
    got = urlfilter.judged(pages(spark)).select(*names).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.fetchall()))


def test_urls_chains_redirects_and_no_rows(spark):
    n = 60
    chain = spark.createDataFrame([(i, f"http://chain.test/{i}", link(f"/{i + 1}") if i < n else link("http://bad.net/")) for i in range(n + 1)], "page_id long, url string, html string")
    assert {r["verdict"] for r in urlfilter.judged(chain).collect()} == {"block"}
    redirects = spark.createDataFrame([("http://chain.test/7", "http://good.org/fr/1"), (None, "http://x.test/"), ("nothing", "http://x.test/")], "src string, dst string")
    assert {r["verdict"] for r in urlfilter.judged(chain, redirects=redirects).collect()} == {"allow"}
    assert urlfilter.judged(chain.limit(0)).collect() == [] and urlfilter.judged(chain.limit(0), redirects=redirects).collect() == []
    rules = [("block", "chain.test", "/1"), ("allow", "chain.test", "/12")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judged(chain.withColumn("html", F.lit(None).cast("string")), rules).collect()}
    assert got[1] == ("chain.test/1", "block") and got[12] == ("chain.test/12", "allow") and got[2] == (None, "allow")


# --- Merkle manifest ---------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_manifest(rows):
    """The contract by lists: rows of (doc_id, text, lang, source, n_chars)."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    say = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, lang, s, n: h("".join(map(say, (d, s, lang, n, t))))
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def reduce_(nodes):
        """The node that remains, and of each the pairs left and right of it on the way."""
        above, ways = list(range(len(nodes))), [[] for _ in nodes]
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for k, a in enumerate(above):
                run, j = runs[a // 16], a % 16
                ways[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above, nodes = [a // 16 for a in above], [h("".join(r)) for r in runs]
        return nodes[0] if nodes else None, ways

    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in order:
        sources[s].sort(key=lambda x: x[:3])
        inner[s] = reduce_([x[2] for x in sources[s]])
    root, outer = reduce_([inner[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (_, _, was, r), way in zip(sources[s], inner[s][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf(r[0], low(r[1]), *r[2:]) if hit else was
            for a, b in (*way, *outer[k]):
                now = h(a + now + b)
            out.append((r[0], was, inner[s][0], root, h("".join(a + b for a, b in (*way, *outer[k]))), now, now == root))
    return sorted(map(str, out))


def manifest_rows():
    rows = [(i * 7 % 1009, f"Text {i} É A" if i % 11 else None, "en", ["big", "b", None, "é", "z"][min(4, i % 23 // 4)] if i % 3 else "big", i) for i in range(700)]
    rows += [(None, "No id", None, "big", None), (None, None, None, None, None), (5, "", "", "", 0), (5, "", "", "", 0), (77, "A" * 300_000, "en", "lone", 300_000)]
    return rows + [(40, "A row that repeats", "en", "hot", 1)] * 300


@pytest.mark.parametrize("height, bound", [(3, 4096), (1, 8), (2, 3), (1, 1)])
def test_manifest_equals_plain(spark, height, bound):
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(4).withColumns({"tree": F.lit(1), "digest": F.lit("x"), "idx": F.lit(2), "n": F.lit(3), "at": F.lit(4), "found": F.lit("f"), "block": F.lit(0)})
    got = merkle.manifest(docs, merkle.lowered_where_fifth(docs), height=height, bound=bound)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_manifest(rows)


def test_manifest_many_sources_small_and_empty(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 400:03}", i) for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS)
    for some, bound in ((rows, 20), (rows[:1], 4096), (rows[:1], 1), (rows[:17], 4), ([], 4096), ([], 0)):
        got = merkle.manifest(spark.createDataFrame(some, DOCS), merkle.lowered_where_fifth(docs), height=1, bound=bound)
        assert sorted(str(tuple(r)) for r in got.collect()) == plain_manifest(some)


def test_manifest_paths_prove_and_untouched_rows_verify(spark):
    docs = spark.createDataFrame(manifest_rows(), DOCS)
    for r in merkle.manifest(docs, paths=True, height=2, bound=5).collect():
        assert r["verified"] and r["folded_root"] == r["root"] == merkle.fold(r["leaf"], [(p["l"], p["r"]) for p in r["path"]])
    text_ids = spark.createDataFrame([("b", "x", "en", "s", 1), (None, "y", "en", "s", 1)], DOCS.replace("doc_id long", "doc_id string"))
    assert {r["doc_id"] for r in merkle.manifest(text_ids).collect()} == {"b", None}


def test_manifest_sql_on_the_fixture():
    rows = manifest_rows()
    con = duckdb.connect()
    con.register("documents", pa.table({c: pa.array([r[k] for r in rows], pa.string() if c in ("text", "lang", "source") else pa.int64()) for k, c in enumerate(("doc_id", "text", "lang", "source", "n_chars"))}))
    want = con.execute(sql.OP13)
    assert [d[0] for d in want.description] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in want.fetchall()) == plain_manifest(rows)
