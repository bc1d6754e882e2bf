"""Groups by turns of the first pairs against the list rule."""
from __future__ import annotations

import pytest

from lodeweave import catalog
from lodeweave.operators import relations as R

from .test_groups import CASES, SCHEMA


def rows(groups):
    return sorted((sorted(g.members), sorted(g.entities), sorted(g.concepts), g.score) for g in groups)


@pytest.mark.parametrize("case, turn, most, turns", [("random", 9, 0, 99), ("shapes", 25, 12, 2)])
def test_turns_and_parts_equal_the_list_rule(spark, case, turn, most, turns, monkeypatch):
    monkeypatch.setattr(R, "TURNS", turns)
    pairs = CASES[case]
    told = spark.createDataFrame([(a, b, e, c) for a, b, _, e, c in pairs], "a long, b long, entities array<string>, concepts array<string>")
    got = R.grouped_pairs(spark.createDataFrame(pairs, SCHEMA).drop("entities", "concepts"), most=most, rounds=60, turn=turn, sets=lambda x: x.join(told, ["a", "b"])).collect()
    assert sorted((r["members"], r["entities"], r["concepts"], r["score"]) for r in got) == rows(R.greedy_groups(pairs))


def test_a_long_chain_of_falling_scores_takes_few_rounds(spark):
    """A link that is the first of neither end but the one before it took a round each."""
    pairs = [(i, i + 1, 1 - i / 1000, ["a"], []) for i in range(200)]
    got = R.grouped_pairs(spark.createDataFrame(pairs, SCHEMA), most=0, rounds=2).collect()
    assert [(r["group"], r["members"], r["entities"]) for r in got] == [(0, list(range(201)), ["a"])]


def test_groups_of_memories_without_language(spark, tmp_path):
    docs = [(0, "Alphabeta Gammadelta", None, "s"), (1, "Alphabeta Gammadelta", None, "s"), (2, "Epsilon Alphabeta", None, None), (3, "Epsilon Alphabeta", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = catalog.queries()["e8_consolidation_groups"](spark, str(tmp_path)).collect()
    assert {r["members"] for r in got} == {"0,1", "2,3"}
