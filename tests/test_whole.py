"""Queries over small tables, held against plain Python: nothing of the input is left out."""
from __future__ import annotations

import math
import re

import pytest

from lodeweave import catalog
from lodeweave.operators import graph, ingest, relations
from lodeweave.plans import graphs
from lodeweave.plans import search as plans

Q = catalog.queries()
DOC = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes documents (doc_id, text, lang, source) and labels (doc_id, quality, toxic); gives the folder."""

    def write(docs, labels=()):
        spark.createDataFrame([(*d, len(d[1])) for d in docs], DOC).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return write


def similarity(a, b):
    x, y = ({f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", t.lower()) for i in range(len(w) + 1)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def test_lexical_search_reads_whole_texts(spark, tables):
    far = "zz " * 100
    docs = [(0, far + plans.QUERY, "en", "s"), (1, plans.QUERY + " " + far, "en", "s"), (2, far, "en", "s"), (3, plans.QUERY + " " + far + " ".join(f"w{i}q" for i in range(300)), "en", "s"), (4, far + "nation", "en", "s"), (5, "", "en", "s")]
    sf = tables(docs)
    want = {d[0]: similarity(d[1], plans.QUERY) for d in docs}
    best = {d[0]: max(want[d[0]], similarity(" ".join(d[1].split(" ")[:5]), plans.QUERY)) for d in docs}
    assert {r["doc_id"]: r["sim"] for r in Q["q1_trgm"](spark, sf).collect()} == pytest.approx(want, abs=1e-7)
    assert {r["id"]: r["score"] for r in Q["q2_lexical"](spark, sf).collect()} == pytest.approx({k: v for k, v in best.items() if v >= 0.3}, abs=1e-7)
    assert {r["doc_id"] for r in Q["q3_similarity_threshold"](spark, sf).collect()} == {k for k, v in want.items() if v >= plans.LEAST} == {0, 1}
    assert {r["id"]: r["score"] for r in Q["q4_memory_lexical"](spark, sf).collect()} == {0: 0.95, 1: 1.0, 3: 1.0, 4: 0.95}


def test_candidates_are_those_of_the_last_days(spark, tables):
    sf = tables([(i, "text", "en" if i % 2 else "xx", "s") for i in range(0, 2000, 5)])
    got = {r["id"] for r in Q["e10_candidates"](spark, sf).collect()}
    assert got == {i for i in range(0, 2000, 5) if i % 2 and i >= 1995 - 30 * 24}


def test_zoom_takes_a_percentage_and_its_ancestors(spark, tmp_path):
    parts = [(i, f"p{i}", "Brand#2", i % 50, 100.0 + i) for i in range(301)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(900 + i % 3, i) for i in range(301)], "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    score = lambda p: round(p[3] / 100 * 0.4 + min(p[4] / 500, 1) * 0.3 + len(p[1]) / 100 * 0.3, 8)
    best = [p[0] for p in sorted(parts, key=lambda p: (-score(p), p[0]))[: -(-301 * graphs.ZOOM // 100)]]
    assert [r["p_partkey"] for r in Q["g21_zoom_scores"](spark, str(tmp_path)).collect()] == best
    up = {1000000 + i: 900 + i % 3 for i in range(301)} | {k: max(1000000 + i for i in range(301) if i % 7 == k) for k in range(7)}
    want = set()
    for n in (1000000 + i for i in best):
        while n is not None and n not in want:
            want.add(n)
            n = up.get(n)
    assert {r["node"] for r in Q["g21b_zoom_ancestors"](spark, str(tmp_path)).collect()} == want


def test_module_names_of_all_languages(spark, tables):
    sf = tables([(i, "text", "en", "s") for i in range(16)])
    want = ["s.en.main", "s.en", "s.en.vite.config", "s.en.a.spec", "s.en.__tests__.b", "s.en.README.md", "src.s.en.src.x.GO", "s.en.noext"]
    assert {r["doc_id"]: r["module"] for r in Q["i10_name_path"](spark, sf).collect()} == {i: want[i % 8] for i in range(16)}


def test_limits_are_by_lines_and_by_chunks_of_a_file(spark, tables):
    long = "\n".join(f"line {i} of a long text" for i in range(6000))
    sf = tables([(0, long, "en", "s"), *((i, f"short text {i}", "en", "s") for i in range(1, 70))])
    got = [(r["doc_id"], r["n"]) for r in Q["i12_limits"](spark, sf).collect()]
    assert sorted(got) == [(0, n) for n in range(50)] + [(i, 0) for i in range(1, 70)]
    files = spark.createDataFrame([("a.d.ts", long), ("b.d.ts", "short"), ("c.ts", long)], "path string, text string")
    kept = ingest.limited_chunks(files, files["path"], files["text"]).groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in kept} == {"b.d.ts": 1, "c.ts": 50}


def test_relationships_by_concepts_and_tags(spark):
    ents = {1: {"redis", "kafka"}, 2: {"redis"}, 3: set(), 4: set(), 5: {"lone"}, 6: set()}
    cons = {1: {"cache"}, 2: {"cache", "x"}, 3: {"x"}, 4: set(), 5: {"y"}, 6: {"z"}}
    tags = {1: {"t"}, 2: set(), 3: {"u"}, 4: {"u"}, 5: {"t", "u"}, 6: {"w"}}
    e = spark.createDataFrame([(i, n) for i in ents for n in ents[i]], "id long, name string")
    m = spark.createDataFrame([(i, sorted(cons[i]), sorted(tags[i])) for i in cons], "id long, concepts array<string>, tags array<string>")
    for least in (0.0, 0.1, 0.15):
        want = {}
        for a in ents:
            for b in range(a + 1, 7):
                idf = sum(math.log(100 / sum(n in v for v in ents.values())) for n in ents[a] & ents[b])
                score = min(1.0, 0.5 * idf / max(1, len(ents[a] | ents[b])) + sum(w * len(f[a] & f[b]) / max(1, len(f[a] | f[b])) for w, f in ((0.3, cons), (0.2, tags))))
                kinds = [k for k, f in (("shared_entity", ents), ("shared_concept", cons), ("shared_tag", tags)) if f[a] & f[b]]
                if kinds and score >= least:
                    want[a, b] = score, ",".join(kinds)
        got = {(r["a"], r["b"]): r for r in relations.relationships(e, m, 100, least).collect()}
        assert {k: r["types"] for k, r in got.items()} == {k: v[1] for k, v in want.items()}
        assert {k: r["score"] for k, r in got.items()} == pytest.approx({k: v[0] for k, v in want.items()})


def test_relationship_query_keeps_pairs_without_entities(spark, tables):
    sf = tables([(0, "no names", "en", "s"), (1, "none here", "en", "s"), (2, "nor here", "de", "other")], [(2, 1, 0)])
    assert [tuple(r) for r in Q["e5_relationship"](spark, sf).collect()] == [(0, 1, 0.5, "shared_concept,shared_tag")]


def test_consolidation_groups_span_sources(spark, tables):
    texts = ["Alphabeta Gammadelta", "Alphabeta Gammadelta", "Alphabeta Gammadelta", "Epsilonzeta Etathetaiota", "Epsilonzeta Etathetaiota", "nothing", "nothing", "nothing"]
    sf = tables([(i, t, "en", f"s{i}") for i, t in enumerate(texts)])
    assert {r["members"] for r in Q["e8_consolidation_groups"](spark, sf).collect()} == {"0,1,2", "3,4"}


def test_components(spark):
    chain, star = [(i, i + 1) for i in range(20)], [(100, 100 + i) for i in range(1, 9)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([*chain, *star, (50, 40), (41, 50)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(9)} | {40: 40, 41: 40, 50: 40}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_short_names_are_entities(spark, tables):
    sf = tables([(0, "Hand of Reason", "en", "s"), (1, "the Hand", "de", "t"), (2, "Abc Zuerich", "fr", "u")])
    assert {tuple(r) for r in Q["e4_entity_frequency"](spark, sf).collect()} == {("Hand", 2), ("Reason", 1), ("Zuerich", 1)}
    assert [(r["a"], r["b"]) for r in Q["e9b_backfill"](spark, sf).collect()] == [(0, 1)]
