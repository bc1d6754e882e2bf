"""Search entry points on small tables."""
from __future__ import annotations

import datetime as dt

import pytest

from lodeweave.operators import hybrid

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "process_payment", "def process_payment(amount): charge card", "billing.process_payment", "python", [1.0, 0.0]),
        (2, "process_order", "def process_order(order): ship order", "shop.process_order", "python", [0.8, 0.6]),
        (3, "render", "function render() {}", "ui.render", "javascript", [0.0, 1.0]),
        (4, "unembedded", "nothing to see", "x.unembedded", "python", None),
    ]
    return spark.createDataFrame(rows, "id long, name string, source_code string, name_path string, language string, embedding array<float>")


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_code_search(chunks):
    both = hybrid.search_code(chunks, "process_payment", [1.0, 0.0])
    assert ids(both)[0] == 1 and {r["id"]: r["sources"] for r in both.collect()}[1] == "lexical+vector"
    assert set(ids(hybrid.search_code(chunks, "process_payment"))) == {1, 2}
    assert ids(hybrid.search_code(chunks, "zzz qqq", [0.0, 1.0]))[0] in (2, 3)
    assert ids(hybrid.search_code(chunks, "anything", [0.0, 1.0], filters={"language": "javascript"})) == [3]
    assert 4 not in ids(hybrid.search_code(chunks, "zzz", [1.0, 1.0], lexical=False))
    for bad in ({"query": " "}, {"query": "x", "lexical": False}):
        with pytest.raises(ValueError):
            hybrid.search_code(chunks, **bad)
    rows, more, at = hybrid.page_of(both, 1)
    assert rows.count() == 1 and more and at == 1


@pytest.fixture(scope="module")
def memories(spark):
    rows = [
        (1, "redis cache choice", "we chose redis", [1.0, 0.0], [("redis",)], ["sys:pattern"], "cache", DAY, None, None, 3, 0),
        (2, "redis outage", "redis was down", [0.9, 0.1], [("redis",)], ["ops:candidate"], "", DAY - dt.timedelta(days=300), None, None, 0, 2),
        (3, "lunch", None, None, [], ["x"], None, DAY, None, DAY, 0, 0),
        (4, "redis gone", "redis", [1.0, 0.0], [("redis",)], ["x"], "", DAY, DAY, None, 0, 0),
    ]
    return spark.createDataFrame(rows, "id long, title string, embedding_source string, embedding array<float>, entities array<struct<name:string>>, tags array<string>, auto_tags string, created_at timestamp, deleted_at timestamp, consumed_at timestamp, outcome_positive int, outcome_negative int")


def test_memory_search(memories):
    got = hybrid.search_memories(memories, "redis", DAY, [1.0, 0.0], ["redis"], ["cache"])
    assert ids(got) == [1, 2]  # deleted ones are out, old ones behind
    scores = {r["id"]: r["score"] for r in got.collect()}
    assert scores[2] < scores[1] * 0.1
    by_tags = {r["id"]: r["score"] for r in hybrid.search_memories(memories, "redis", DAY, by_tags=True).collect()}
    assert by_tags[1] > scores[1] * 0.2 and ids(hybrid.search_memories(memories, "redis", DAY, limit=1, offset=1)) == [2]


def test_memory_listing(memories):
    rows = hybrid.list_memories(memories, limit=2).collect()
    assert len(rows) == 2 and {r["total"] for r in rows} == {3}
    assert [r["id"] for r in hybrid.list_memories(memories, lifecycle="candidate").collect()] == [2]
    assert [r["id"] for r in hybrid.list_memories(memories, consumed=True).collect()] == [3]
    assert [r["id"] for r in hybrid.list_memories(memories, {"any_tags": ["sys:pattern", "zz"]}).collect()] == [1]
    with pytest.raises(ValueError):
        hybrid.list_memories(memories, {"nope": 1})


def test_event_search(spark):
    rows = [(i, DAY + dt.timedelta(hours=i), '{"type": "log", "n": %d}' % (i % 2), [float(i), 0.0] if i else None) for i in range(5)]
    events = spark.createDataFrame(rows, "id long, timestamp timestamp, metadata string, embedding array<float>")
    got = lambda **k: [r["id"] for r in hybrid.search_events(events, **k).collect()]
    assert got() == [4, 3, 2, 1, 0] and got(metadata={"n": 1}) == [3, 1] and got(start=DAY + dt.timedelta(hours=3)) == [4, 3]
    assert got(vector=[2.0, 0.0], limit=2) == [2, 1] and got(vector=[2.0, 0.0], threshold=0.5) == [2]
    assert got(vector=[9.0, 0.0], threshold=0.5, limit=2) == [4, 3]  # nothing within: the nearest
    assert got(vector=[9.0, 0.0], threshold=0.5, metadata={"n": 1}) == []
    assert got(vector=[4.0, 0.0])[-1] == 0  # no vector comes last
