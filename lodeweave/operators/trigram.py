"""A stored trigram index of text fields: posting lists in segments, found and kept by file.

A segment covers some thousand rows. Its rows are numbered by the size of their trigram set, and each trigram of the
segment has a row with the numbers of those that hold it, as steps. The trigrams two texts share and the sizes of their
sets are all that their similarity needs, so a search reads posting lists and never a text:

    similarity = shared / (size + size of the query - shared)

A similarity of t needs a set of at most |query| / t trigrams, which is a prefix of every posting list as rows are
numbered by size, and at least t * max(size, |query|) shared ones. Both bounds are applied to counts before any
similarity is computed, and no other row is touched.

"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .stored import FileIndex, batches_of

BLANK = 32
#: Characters and rows of a segment; rows are numbered in two bytes.
CHARS, ROWS = 1 << 22, 1 << 13
#: Largest product of symbols and rows that one number tells apart.
_ROOM = 1 << 62


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter or a number."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def _code(a, b, c):
    return (a << 42) | (b << 21) | c


def grams_of(text: str) -> np.ndarray:
    """The distinct trigrams of one text in lower case, as numbers."""
    symbols, gram, _ = _grams([text])
    k = len(symbols)
    gram = _distinct(gram)
    return np.sort(_code(symbols[gram // (k * k)], symbols[gram // k % k], symbols[gram % k]))


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once; by sorting, which is many times faster here than hashing."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, grams, rows) of lower-cased texts: words of letters and numbers, each padded by two blanks before and one after. A gram is a number of three digits, places in symbols; grams repeat."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    word = _letters()[points]
    seen = np.zeros(0x110000, bool)
    seen[points[word]] = True
    seen[BLANK] = True
    symbols = np.flatnonzero(seen).astype(np.int64)
    place = np.zeros(0x110000, np.int64)
    place[symbols] = np.arange(len(symbols))
    blank, k = place[BLANK], len(symbols)
    c = np.where(word, place[points], blank)
    one = np.concatenate(([blank], c[:-1]))
    before = np.concatenate(([False], word[:-1]))
    two = np.where(before, np.concatenate(([blank, blank], c))[: len(c)], blank)
    gram = (two * k + one) * k + c
    last = word & ~np.concatenate((word[1:], [False]))
    return symbols, np.concatenate((gram[word], ((one * k + c) * k + blank)[last])), np.concatenate((row[word], row[last]))


def _postings(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(order, sizes, grams, starts, steps): rows in the order of their sizes, and for each gram the steps between the places of its rows; None where one number cannot tell all grams and rows apart."""
    n = len(texts)
    symbols, gram, row = _grams(texts)
    k = len(symbols)
    if k**3 * n >= _ROOM and n > 1:
        return None
    pair = _distinct(gram * n + row)
    gram, row = pair // n, pair % n
    size = np.bincount(row, minlength=n)
    order = np.argsort(size, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    pair = np.sort(gram * n + rank[row])
    gram, row = pair // n, pair % n
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    step = np.diff(row, prepend=0)
    step[first] = row[first]
    g = gram[first]
    return order, size[order], _code(symbols[g // (k * k)], symbols[g // k % k], symbols[g % k]), np.append(first, len(gram)), step


#: The gram of a segment's head, which has the sizes in place of steps, and the ids.
HEAD = -1


def _segment(file: str, field: int, name: str, ids: pa.Array, texts: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    made = _postings(texts)
    if made is None:
        half = len(texts) // 2
        yield from _segment(file, field, f"{name}a", ids[:half], texts[:half], schema)
        yield from _segment(file, field, f"{name}b", ids[half:], texts[half:], schema)
        return
    order, sizes, grams, starts, steps = made
    at = np.argsort(grams, kind="stable")  # symbols stand in the order of code points, so grams already ascend
    assert (np.diff(at) == 1).all()
    n = len(grams)
    data = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((starts * 2).astype(np.int32).tobytes()), pa.py_buffer(steps.astype(np.uint16).tobytes())])
    head = pa.array([sizes.astype(np.int64).tobytes()], pa.binary())
    lists = pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(ids.type))
    rows = {
        "file": pa.array([file] * (n + 1)), "segment": pa.array([name] * (n + 1)), "field": pa.array(np.full(n + 1, field, np.int32)),
        "gram": pa.array(np.append(HEAD, grams)), "rows": pa.concat_arrays([head, data]), "ids": pa.concat_arrays([lists, pa.nulls(n, pa.list_(ids.type))]),
    }
    yield pa.RecordBatch.from_arrays([rows[f.name].cast(f.type) for f in schema], schema=schema)


def _inverted(fields: int, schema: pa.Schema):
    """Rows (file, id, f0, f1, ...) as segments; rows of one file and at most CHARS characters or ROWS rows make one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[str, list[pa.RecordBatch]] = {}
        chars: dict[str, int] = {}

        def flush(file: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = pa.Table.from_batches(held.pop(file)).combine_chunks()
            chars.pop(file)
            for f in range(fields):
                texts = [t or "" for t in rows[f"f{f}"].to_pylist()]
                yield from _segment(file, f, f"{part}-{made}", rows["id"].combine_chunks(), texts, schema)
            made += 1

        for batch in batches:
            size = np.add.reduce([pa.compute.fill_null(pa.compute.binary_length(batch[f"f{f}"]), 0).to_numpy() for f in range(fields)])
            whole = pa.compute.dictionary_encode(batch["file"])
            for k, file in enumerate(whole.dictionary.to_pylist()):
                own = np.flatnonzero(whole.indices.to_numpy() == k)
                while len(own):
                    room = CHARS - chars.get(file, 0)
                    most = min(len(own), max(1, int(np.searchsorted(np.cumsum(size[own]), room, "right"))), ROWS - sum(map(len, held.get(file, []))))
                    held.setdefault(file, []).append(batch.take(pa.array(own[:most])))
                    chars[file] = chars.get(file, 0) + int(size[own[:most]].sum())
                    own = own[most:]
                    if chars[file] >= CHARS or len(own) or sum(map(len, held[file])) >= ROWS:
                        yield from flush(file)
            for file in list(held)[:-1]:  # files come one after another
                yield from flush(file)
        for file in list(held):
            yield from flush(file)

    return run


def _counts(query: list[int], least: float, every: bool, kind: T.DataType):
    """A segment's rows that can reach the similarity ``least`` with the query: id, shared, size. every: all rows of the segment."""
    most = math.floor(len(query) / least + 1e-9) if least > 0 else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["gram"] == HEAD].iloc[0]
        size = np.frombuffer(head["rows"], np.int64)
        upto = len(size) if most is None else int(np.searchsorted(size, most, "right"))
        shared = np.zeros(upto, np.int64)
        for blob in pdf.loc[pdf["gram"] != HEAD, "rows"]:
            at = np.cumsum(np.frombuffer(blob, np.uint16).astype(np.int64))
            shared[at[: np.searchsorted(at, upto)]] += 1
        if every:
            kept = np.arange(upto)
        else:
            kept = np.flatnonzero((shared > 0) & (shared >= least * np.maximum(size[:upto], len(query)) - 1e-9))
        ids = head["ids"]
        return pd.DataFrame({"id": pd.Series([ids[i] for i in kept], dtype=object), "shared": shared[kept], "size": size[kept]})

    return run


class TrigramIndex(FileIndex):
    """The index of the files of one Parquet table: fields are columns of text, by name."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: dict[str, Column], base: str | None = None):
        self.key, self.fields = key, fields
        super().__init__(spark, path, "trigrams", repr((key, [(n, str(c)) for n, c in fields.items()])), base)
        self.kind = spark.read.parquet(path).schema[key].dataType
        self.schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("segment", T.StringType()), T.StructField("field", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("rows", T.BinaryType()), T.StructField("ids", T.ArrayType(self.kind))])

    def build(self, rows: DataFrame, target: str) -> None:
        rows = rows.select("file", F.col(self.key).alias("id"), *[F.lower(c).alias(f"f{i}") for i, c in enumerate(self.fields.values())])
        arrow = pa.schema([("file", pa.string()), ("segment", pa.string()), ("field", pa.int32()), ("gram", pa.int64()), ("rows", pa.binary()), ("ids", pa.list_(to_arrow_type(self.kind)))])
        with batches_of(self.spark, 2000):
            rows.mapInArrow(_inverted(len(self.fields), arrow), self.schema).write.option("parquet.page.size", str(1 << 15)).option("compression", "zstd").parquet(target)

    # -- searching --------------------------------------------------------------

    def _matched(self, field: str, query: str, least: float, every: bool) -> tuple[DataFrame, int]:
        grams = grams_of(query.lower()).tolist()
        at = list(self.fields).index(field)
        rows = self.table().where((F.col("field") == at) & F.col("gram").isin([HEAD, *grams])).select("file", "segment", "gram", "rows", "ids")
        out = T.StructType([T.StructField("id", self.kind), T.StructField("shared", T.LongType()), T.StructField("size", T.LongType())])
        return rows.groupBy("file", "segment").applyInPandas(_counts(grams, least, every, self.kind), out), len(grams)

    @staticmethod
    def _similarity(n: int) -> Column:
        return F.coalesce(F.try_divide(F.col("shared"), F.col("size") + n - F.col("shared")), F.lit(0.0))

    def similarities(self, field: str, query: str) -> DataFrame:
        """(id, sim) of every row of the table."""
        rows, n = self._matched(field, query, 0.0, True)
        return rows.select("id", self._similarity(n).alias("sim"))

    def alike(self, field: str, query: str, least: float) -> DataFrame:
        """(id, sim) of the rows whose similarity is at least ``least``, which is above 0."""
        if least <= 0:
            raise ValueError("a least similarity above 0 is needed; similarities() has all rows")
        rows, n = self._matched(field, query, least, False)
        return rows.select("id", self._similarity(n).alias("sim")).where(F.col("sim") >= least)

    def candidates(self, field: str, query: str, least: float) -> int:
        """How many rows the bounds leave, of which similarities are computed."""
        return self._matched(field, query, least, False)[0].count()


def lexical(index: TrigramIndex, fields: list[str], query: str, threshold: float, limit: float) -> DataFrame:
    """(id, score): rows of which a field's similarity reaches limit and the largest exceeds threshold; score is the largest."""
    least = max(limit, threshold)
    parts = None
    for f in fields:
        one = index.alike(f, query, least)
        parts = one if parts is None else parts.unionByName(one)
    best = parts.groupBy("id").agg(F.max("sim").alias("score"))
    return best.where(F.col("score") >= limit if limit > threshold else F.col("score") > threshold)


def memory_lexical(df: DataFrame, title: Column, source: Column, query: str, alike: Callable[[str, float], list[DataFrame]], limit: float = 0.3) -> DataFrame:
    """(id, score): titles and sources that hold the query (1.0, 0.95) or are like it. alike(query, limit): lists (id, sim) of an index."""
    like = f"%{query}%"
    held = F.when(title.ilike(like), F.lit(1.0)).when(F.coalesce(source, F.lit("")).ilike(like), F.lit(0.95))
    found = df.select("id", held.alias("sim")).where("sim IS NOT NULL")
    for one in alike(query, limit):
        found = found.unionByName(one)
    return found.groupBy("id").agg(F.max("sim").alias("score"))
