"""Mixing, sharding, Jaccard join, language model and classifiers on small tables."""
from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.llm import jaccard, lmscore, mixing, quality, sharding, toxicity
from lodeweave.llm._common import fold, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


# --- mixing ------------------------------------------------------------------


def expected_targets(sizes):
    """Water filling by repeated sharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, capped = float(sum(sizes.values())), {}
    while True:
        rest = {s: w[s] for s in names if s not in capped}
        if not rest:
            return capped
        share = {s: left * w[s] / sum(rest.values()) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return capped | share
        for s in over:
            capped[s] = 3.0 * sizes[s]
            left -= capped[s]


def test_mix_meets_targets(spark):
    pick = random.Random(2)
    rows = []
    for s, n in (("a", 400), ("b", 40), ("c", 300), ("d", 6), (None, 90), ("é", 60), ("z", 0)):
        rows += [(len(rows) + i, " ".join(["w"] * pick.randint(1, 60)), s) for i in range(n)]
    rows += [(9_000, None, "a"), (9_001, "", "q"), (9_002, " \t", "q")]
    got = mixing.mix(documents(spark, rows)).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
    assert len(got) == len(rows)
    want = expected_targets({s: sizes[s] for s in target})
    for s in target:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 60  # the longest document
    again = mixing.mix(documents(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_inclusion_is_unequal_and_follows_pi(spark):
    rows = [(i, " ".join(["w"] * (20 if i % 2 else 600)), "a" if i < 2000 else "b") for i in range(4000)]
    got = mixing.mix(documents(spark, rows), tilt=0.2).collect()
    mean = defaultdict(list)
    for r in got:
        mean[r["source"], r["size"]].append(r["copies"])
    assert np.mean(mean["a", 600]) > np.mean(mean["a", 20])
    assert np.mean(mean["b", 600]) > np.mean(mean["b", 20]) > 0


def test_mixed_repeats_rows(spark):
    rows = [(i, f"w{i} x y", "abc"[i % 3]) for i in range(300)]
    docs = documents(spark, rows).withColumnRenamed("n_chars", "copies")
    took = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    made = mixing.mixed(docs)
    assert made.columns == docs.columns
    assert Counter(r["doc_id"] for r in made.collect()) == {k: v for k, v in took.items() if v}
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def plain_copies(rows, cap=3.0, tilt=0.1):
    """The mix by lists: rows of (source, size, hash); copies of each."""
    sizes = Counter()
    for s, n, _ in rows:
        sizes[s] += n
    target = expected_targets(sizes)
    cls = lambda n: min(12, max(4, int(math.log2(max(n, 1)))))
    out = [0] * len(rows)
    for s in sizes:
        own = [i for i, r in enumerate(rows) if r[0] == s]
        pref = {c: 1 + tilt * (c - 4) for c in {cls(rows[i][1]) for i in own}}
        words = {c: sum(rows[i][1] for i in own if cls(rows[i][1]) == c) for c in pref}
        full = lambda lam: sum(w * min(cap, lam * pref[c]) for c, w in words.items())  # noqa: E731, B023
        lo, hi = 0.0, cap / min(pref.values())
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if full((lo + hi) / 2) < target[s] else (lo, (lo + hi) / 2)
        mean = {c: min(cap, hi * p) for c, p in pref.items()}
        whole = {c: math.floor(a + 1e-9) for c, a in mean.items()}
        left = sum(w * max(0.0, mean[c] - whole[c]) for c, w in words.items())
        ranked = []
        for i in own:
            c = cls(rows[i][1])
            out[i] = whole[c] if rows[i][1] else 0
            pi = mean[c] - whole[c]
            if pi > 1e-9 and rows[i][1]:
                u = ((rows[i][2] % (1 << 64) >> 12) + 0.5) / (1 << 52)
                ranked.append((u / (1 - u) / (pi / (1 - pi)), i))
        taken = 0
        for _, i in sorted(ranked):
            if taken + rows[i][1] / 2 > left + 1e-6:
                break
            out[i] += 1
            taken += rows[i][1]
    return out


def test_mix_equals_a_plain_ranking(spark):
    from pyspark.sql import functions as F

    pick = random.Random(4)
    made = [(i, " ".join(["w"] * pick.choice([0, 3, 9, 40, 90, 700])), pick.choice(["a", "a", "a", "b", None])) for i in range(900)]
    docs = documents(spark, made)
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", mixing._hash(0).alias("h")).collect()}
    want = plain_copies([(s, len(t.split()), hashes[i]) for i, t, s in made])
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert [got[i] for i, _, _ in made] == want


def test_mix_meets_targets_with_a_repeated_row(spark):
    """A third of all rows is one row, which is nearly all of its source."""
    rows = [(i, " ".join(["w"] * (1 + i % 30)), "ac"[i % 2]) for i in range(4000)]
    rows += [(9_000, "five words of one row", "b")] * 2000 + [(9_001, "two words", "b"), (None, None, "b"), (None, None, "b")]
    docs = documents(spark, rows).repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken, target, copies = Counter(), {}, Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        copies[r["doc_id"], r["copies"]] += 1
    want = expected_targets({s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in "abc"})
    for s in "abc":
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 30
    assert sum(n > 0 for (i, _), n in copies.items() if i == 9_000) == 2  # some copies once more than others
    again = mixing.mix(docs.repartition(3, "lang")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    made = Counter(r["doc_id"] for r in mixing.mixed(docs.withColumn("part", F.lit(1))).collect())
    assert made == Counter({i: sum(k * n for (j, k), n in copies.items() if j == i) for i in {j for j, k in copies if k}})


# --- sharding ----------------------------------------------------------------


def test_a_repeated_row_is_dealt_over_the_buckets(spark):
    rows = [(i, f"t{i}", "a") for i in range(4000)] + [(7, "the same", "a")] * 2000 + [(8, "also the same", None)] * 700
    docs = documents(spark, rows).repartition(6)
    measured = sharding.durable(sharding._measured(docs).withColumn("place", F.monotonically_increasing_id()), "test")
    key = [F.col(c) for c in ("source", "doc_id", "text_crc32", "size")]
    told, copy = sharding._told_apart(measured, key, ["place"])
    numbers = defaultdict(list)
    for r in told.collect():
        numbers[r["doc_id"], r["text_crc32"]].append(r[copy])
    assert all(sorted(v) == (list(range(len(v))) if len(v) > sharding.REPEATS else [0] * len(v)) for v in numbers.values())
    u = F.shiftrightunsigned(F.xxhash64(F.lit(0), *key[1:], F.col(copy)), 11) / F.lit(float(1 << 53))
    buckets = [r["n"] for r in told.groupBy(F.floor(u * 20)).agg(F.count("*").alias("n")).collect()]
    assert len(buckets) == 20 and max(buckets) <= 2 * len(rows) / 20
    for got in (sharding.shard_listing(docs), sharding.sharded(docs)):
        by = defaultdict(list)
        for r in got.collect():
            by[r["shard"]].append((r["slot"], r["source"]))
        assert sorted(len(v) for v in by.values()) == [418] * 4 + [419] * 12
        for own in by.values():
            assert sorted(s for s, _ in own) == list(range(len(own))) and abs(sum(s is None for _, s in own) - 700 / 16) <= 2



def test_shards_equal_a_plain_ranking(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 50}", "hot" if i % 3 else [None, "b", "c"][i % 9 // 3]) for i in range(700)]
    docs = documents(spark, rows)
    key = sharding._measured(docs).select("doc_id", "source", F.xxhash64(F.lit(0), "doc_id", "text_crc32", "size").alias("h")).collect()
    place = {}
    for s in {r["source"] for r in key}:
        own = sorted((r["h"] % (1 << 64) >> 11, r["doc_id"]) for r in key if r["source"] == s)
        for rank, (u, i) in enumerate(own, 1):
            place[i] = ((2 * rank - 1) / (2 * len(own)), s is None, s or "", u)
    order = sorted(place, key=place.get)
    small, more = divmod(len(rows), 16)
    want, at = {}, 0
    for shard in range(16):
        for slot in range(small + (shard < more)):
            want[order[at]] = (shard, slot)
            at += 1
    for per_bucket in (2000, 20):
        out = sharding.interleave(sharding._measured(docs), 16, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], per_bucket=per_bucket)
        assert {r["doc_id"]: (r["shard"], r["slot"]) for r in out.collect()} == want


def test_shards_are_even_and_match_the_mixture(spark):
    rows = [(i % 950, f"t{i}" if i % 7 else "same", ("hot" if i % 3 == 0 else f"s{i % 5}") if i % 11 else None) for i in range(1003)]
    rows += [(None, None, None)] * 4
    docs = documents(spark, rows)
    got = sharding.shard_listing(docs, shards=16).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    for s, n in Counter(r["source"] for r in got).items():
        for own in by.values():
            assert abs(sum(r["source"] == s for r in own) - n / 16) <= 2
    for r in got:
        assert r["grown_shard"] is None and r["law"] == "rows"
    sizes = {zlib.crc32((t or "").encode()): len((t or "").encode()) + 1 for _, t, _ in rows}
    assert all(sizes[r["text_crc32"]] == r["size"] for r in got)
    again = sharding.shard_listing(docs.repartition(5), shards=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_sharded_keeps_columns_and_few_rows(spark):
    docs = documents(spark, [(1, "a", "x"), (2, "b", None), (3, None, "x")]).withColumnRenamed("n_chars", "slot")
    out = sharding.sharded(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "shard", "slot"]
    assert sorted((r["shard"], r["slot"]) for r in out.collect()) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.sharded(docs.limit(0)).count() == 0


# --- Jaccard join ------------------------------------------------------------


def word_sets(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, word_sets(t)) for i, t in rows if i is not None]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {i: find(i) for i in ids}


def edited(pick, w, rate):
    return [x if pick.random() > rate else f"e{pick.randint(0, 10**6)}" for x in w]


def near_copies(seed):
    pick = random.Random(seed)
    rows = []
    for _ in range(14):
        base = [f"w{pick.randint(0, 3000)}" for _ in range(pick.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 60, 200, 700]))]
        for _ in range(pick.randint(1, 9)):
            w = edited(pick, base, pick.choice([0, 0.005, 0.02, 0.05]))
            cut = pick.choice([0, 0, 1, len(w) // 8])
            rows.append((len(rows), " ".join(w[: len(w) - cut]).upper() if pick.random() < 0.3 else " \n".join(w[: len(w) - cut])))
    passage = [f"p{i}" for i in range(40)]
    for _ in range(40):
        own = [f"q{pick.randint(0, 10**6)}" for _ in range(pick.choice([10, 30, 100]))]
        rows.append((len(rows), " ".join(own + passage)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t "), (None, "w1"), (3, rows[3][1]), (len(rows) + 3, rows[20][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    got = jaccard.classes(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(word_sets(t))) for i, t in rows)


def test_large_near_group_loses_no_link(spark):
    pick = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(pick, base, pick.choice([0.01, 0.03, 0.06])))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.classes(docs).collect()} == brute_components(rows)


def test_signatures_meet_for_every_similar_pair():
    pick = np.random.default_rng(4)
    for n in [*range(1, 40), 64, 99, 100, 145, 300, 1000, 2500]:
        for _ in range(12):
            pool = pick.integers(0, 2**64, 2 * n + 8, dtype=np.uint64)
            a = np.unique(pool[:n])
            differ = int(pick.integers(0, n // 3 + 1))
            gone = int(pick.integers(0, differ + 1))
            b = np.unique(np.concatenate([a[gone:], pool[n : n + differ - gone]]))
            if jaccard.similar(a, b):
                assert len(np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)))
                assert jaccard.distance(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 502), (502, 501)] + [(1000, k) for k in range(1001, 1040)]
    comps = {r["doc"]: r["comp"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {comps[i] for i in range(201)} == {0} and comps[501] == 500 and {comps[k] for k in range(1000, 1040)} == {1000}
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    rows = [(i, t, "s") for i, t in near_copies(3) if i is not None]
    docs = documents(spark, rows)
    want = brute_components([(i, t) for i, t, _ in rows])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)
    assert jaccard.keep_one(docs.limit(0)).count() == 0 and jaccard.classes(docs.limit(0)).count() == 0


def test_keep_one_with_clashing_columns_and_repeated_rows(spark):
    from pyspark.sql import functions as F

    text = "one two three four five six seven"
    rows = [(1, text, "b"), (1, text, "a"), (1, "other words of the same number here", "c"), (2, text, "d"), (3, "alone here", "e"), (3, "alone here", "e"), (None, text, "f"), (4, None, "g"), (4, "", "h")]
    docs = documents(spark, rows).withColumns({"k": F.lit(1), "c": F.lit(2), "row": F.lit(3), "n": F.lit(4), "m": F.create_map(F.lit("x"), F.lit(1))})
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["source"], r["k"], r["c"], r["row"], r["n"], r["m"]["x"]) for r in kept.collect()) == [(0, "f", 1, 2, 3, 4, 1), (1, "a", 1, 2, 3, 4, 1), (3, "e", 1, 2, 3, 4, 1), (4, "g", 1, 2, 3, 4, 1)]
    hot = documents(spark, [(7, text, "s")] * 400 + [(i, text, "s") for i in range(8, 300)])
    assert [r["doc_id"] for r in jaccard.keep_one(hot).collect()] == [7]


def test_ids_have_to_be_integers(spark):
    with pytest.raises(TypeError, match="integer"):
        jaccard.classes(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    got = jaccard.classes(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id int, text string")).collect()
    assert {r["component_id"] for r in got} == {1}


def test_scratch_tables_go(spark, tmp_path):
    from lodeweave.llm._common import Scratch, shared_dir

    before = {p.name for p in Path(shared_dir(spark), "lodeweave").glob("jaccard-*")}
    out = jaccard.classes(spark.createDataFrame([(i, f"w{i % 5} x y z a b c") for i in range(40)], "doc_id long, text string"))
    [made] = [p for p in Path(shared_dir(spark), "lodeweave").glob("jaccard-*") if p.name not in before]
    assert [p.name.split("-")[0] for p in made.iterdir()] == ["result"] and out.count() == 40
    scratch = Scratch(spark, "test")
    a = scratch.keep(spark.range(3), "t")
    b = scratch.keep(a, "t", replace=True)
    assert b.count() == 3 and len(list(Path(scratch.base).iterdir())) == 1


# --- language model ----------------------------------------------------------


def every_segmentation(data, logp):
    total = 0.0

    def go(i, p):
        nonlocal total
        if i == len(data):
            total += p
        for j in range(i + 1, len(data) + 1):
            if data[i:j] in logp:
                go(j, p * math.exp(logp[data[i:j]]))

    go(0, 1.0)
    return total


def test_lattice_sums_all_segmentations():
    logp = {bytes([b]): math.log(0.01) for b in range(256)} | {b"ab": math.log(0.1), b"abc": math.log(0.05), lmscore._START: math.log(0.2), lmscore._START + b"a": math.log(0.07), b"bc": math.log(0.02)}
    lattice = lmscore.Lattice(logp, math.log(0.1))
    for w in (b"", b"a", b"abc", b"abcab", b"zzabc"):
        assert lattice.log10(w) == pytest.approx(math.log10(every_segmentation(lmscore._START + w, logp)))
    uses: dict = {}
    lattice.expect(b"abcab", 2.0, uses)
    assert sum(len(k) * v for k, v in uses.items()) == pytest.approx(2 * len(lmscore._START + b"abcab"))
    again = lattice.updated(uses, 3.0)
    assert sum(map(math.exp, again.logp.values())) + math.exp(again.end) == pytest.approx(sum(map(math.exp, logp.values())) * 0 + (sum(uses.values()) + 3 + 1000 * (sum(map(math.exp, logp.values())) + 0.1)) / (sum(uses.values()) + 1003))


@pytest.mark.parametrize("hot", [5, 100_000])
def test_lm_base_score_and_totals(spark, hot):
    pick = random.Random(6)
    rows = [(i, " ".join(pick.choice(["The", "the", "cat", "Äpfel", "x1", f"r{i}"]) for _ in range(pick.randint(0, 30)))) for i in range(60)] + [(70, None), (71, ""), (72, "\x0b\x1cA b")]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    from lodeweave.llm._common import fold
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in lmscore.score_documents(docs.select("doc_id", "text"), fold(F.col("doc_id"), 7) != 2, hot=hot).collect()}
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0
    assert got[70]["score"] == pytest.approx(got[71]["score"])


def test_long_words_take_the_same_way(monkeypatch):
    logp = {bytes([b]): math.log(0.01) for b in range(256)} | {b"ab": math.log(0.1), b"abc": math.log(0.05), lmscore._START: math.log(0.2), lmscore._START + b"a": math.log(0.07), b"bc": math.log(0.02)}
    lattice, word = lmscore.Lattice(logp, math.log(0.1)), b"abcabcbcaab" * 30
    whole, uses, other = lattice.log10(word), {}, {}
    lattice.expect(word, 2.0, uses)
    monkeypatch.setattr(lmscore, "LONG", 4)
    assert lattice.log10(word) == pytest.approx(whole)
    lattice.expect(word, 2.0, other)
    assert other == pytest.approx(uses)
    assert lattice.log10(b"abc" * 100_000) < -1000


def test_scores_of_rare_words_equal_those_of_hot_ones(spark):
    pick = random.Random(8)
    rows = [(i, " ".join(pick.choice(["the", "cat", f"r{i}", "Äpfel", "x" * 40]) for _ in range(pick.randint(0, 20)))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from lodeweave.llm._common import fold
    from pyspark.sql import functions as F

    train = fold(F.col("doc_id"), 7) != 2
    few, all_ = ({r["doc_id"]: r["score"] for r in lmscore.score_documents(docs, train, hot=h).collect()} for h in (1, 1000))
    assert few == pytest.approx(all_)


def test_long_words_are_never_broadcast(spark, monkeypatch):
    """A long word among the commonest goes by the join; scores are the same."""
    long = "w" * 500
    docs = documents(spark, [(i, f"{long} the cat {long}" if i % 2 else f"the {long} " + "z" * 65, "s") for i in range(40)]).select("doc_id", "text")
    train = fold(F.col("doc_id"), 7) != 2
    sent = []
    whole = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: sent.append(v) or whole(v))
    got = {r["doc_id"]: r for r in lmscore.score_documents(docs, train).collect()}
    common = [v[0] for v in sent if isinstance(v, tuple)]
    assert len(common) == 1 and set(common[0]) == {b"the", b"cat"}
    monkeypatch.setattr(lmscore, "HOT_BYTES", 1000)
    held = {r["doc_id"]: r for r in lmscore.score_documents(docs, train).collect()}
    for i, r in got.items():
        assert (r["n_tokens"], r["n_known"]) == (held[i]["n_tokens"], held[i]["n_known"])
        assert r["score"] == pytest.approx(held[i]["score"]) and r["base_score"] == pytest.approx(held[i]["base_score"])



def test_lm_without_rows(spark):
    assert lmscore.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- classifiers -------------------------------------------------------------


def accuracy(scored, labels, column):
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", column).collect()
    assert len(rows) > 10
    return sum(r["predicted"] == r[column] for r in rows) / len(rows)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert accuracy(out, table(spark, sf, "labels"), "quality") > 0.93
    assert out.where("score is null or score < 0 or score > 1").count() == 0


def plain_score(net, text):
    """The network chunk by chunk: a document between zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, -(-len(data) // 16))
    padded = bytes(32) + data.ljust(16 * n, b"\0") + bytes(32)
    again = np.array([float(any(padded[p : p + 8]) and any(padded[p - k : p - k + 8] == padded[p : p + 8] for k in range(2, 33))) if 32 <= p <= len(padded) - 8 else 0.0 for p in range(len(padded))])
    x = np.concatenate([net.emb[np.frombuffer(padded, np.uint8)], again[:, None]], axis=1)
    chunks = [x[32 + 16 * i : 64 + 16 * i].ravel() @ net.filt + net.fb for i in range(n)]
    hidden = np.maximum(np.maximum(np.max(chunks, axis=0), 0) @ net.hid + net.hb, 0)
    return 1 / (1 + np.exp(-(hidden @ net.out + net.ob[0])))


def test_quality_equals_a_plain_loop(monkeypatch):
    net, pick = quality.Network.new(1), random.Random(3)
    texts = ["", None, "a", "abcabcabcabc abcabc", "x" * 100, "\0\0ab\0ab"] + ["".join(pick.choice("ab \0é") for _ in range(pick.randint(0, 300))) for _ in range(40)]
    want = {t: plain_score(net, t) for t in texts}
    for piece in (1 << 19, 1 << 9):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert net.score(texts) == pytest.approx([want[t] for t in texts], abs=1e-6)


def test_quality_depends_on_the_text_alone(spark):
    net, pick = quality.Network.new(1), random.Random(5)
    calm, loud = "calm words here " * 40_000, "###!!!%%%***" * 6
    texts = [calm, calm + loud, loud + calm, calm[:300_000] + loud + calm[300_000:]] + ["".join(pick.choice("abc ") for _ in range(pick.randint(0, 200))) for _ in range(60)]
    alone = {t: net.score([t])[0] for t in texts}
    for _ in range(5):
        pick.shuffle(texts)
        k = pick.randint(1, len(texts))
        assert net.score(texts[:k]).tolist() == [alone[t] for t in texts[:k]]
    run = quality.scorer(spark.range(1), net)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for parts in (1, 7):
        assert {r["text"]: r["s"] for r in docs.repartition(parts).select("text", run("text").alias("s")).collect()} == alone


def test_quality_without_labels(spark):
    docs = documents(spark, [(1, "a", "s"), (2, None, "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {quality.UNTRAINED}
    assert quality.keep_good(docs.withColumnRenamed("lang", "score"), none).columns == ["doc_id", "text", "score", "source", "n_chars"]
    assert len({r["score"] for r in toxicity.scored(docs, none).collect()}) == 1


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert accuracy(out, table(spark, sf, "labels"), "toxic") > 0.97


def test_toxicity_equals_a_plain_search():
    pick = random.Random(6)
    word = lambda: "".join(pick.choice("abc") for _ in range(pick.randint(1, 5)))
    for _ in range(60):
        weights = {pick.choice([f" {word()} ", f" {word()}"]): pick.randint(1, 9) / 2 for _ in range(6)}
        phrases = tuple({f" {word()} {word()} " for _ in range(4)} - set(weights))
        lex = toxicity.Lexicon(weights, phrases)
        auto = lex.automaton()
        for _ in range(20):
            t = toxicity.folded(" ".join(word() for _ in range(pick.randint(0, 25))))
            places = lambda p: [i for i in range(len(t)) if t.startswith(p, i)]  # noqa: E731, B023
            spared = [(i, i + len(p) - 1) for p in phrases for i in places(p)]
            best = {}
            for p, w in weights.items():
                for i in places(p):
                    if not any(a <= i < b for a, b in spared):
                        best[i] = max(w, best.get(i, 0))
            assert lex.features(auto, t)[0] == pytest.approx(sum(best.values()))


def test_toxicity_folding_and_exceptions():
    lex = toxicity.Lexicon({f" {toxicity.folded('idiot').strip()} ": 4.0, " scum": 3.0}, (toxicity.folded("scum river"),), (-3.0, 2.0, 0.0, 0.0))
    auto = lex.automaton()
    total = lambda t: lex.features(auto, t)[0]
    for t in ("an IDIOT!", "1d10t", "іdіоt", "ídiót", "ｉｄｉｏｔ", "id​iot"):
        assert total(t) == 4.0, t
    assert total("idiotic") == 0 and total("scummy idiot") == 7.0
    assert total("the scum river runs") == 0 and total("scum and river") == 3.0
    assert total(None) == total("") == 0
