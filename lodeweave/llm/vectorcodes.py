"""Vector code compression: product codes learnt by weighted Lloyd over distinct integer parts.

Components become integers floor(scale * x), vectors are cut into equal parts,
and equal parts of one position are counted once, with a weight. The rounds of
Lloyd's algorithm read that table of distinct parts only: a task sums what
belongs to each entry of a codebook, so that a round hands back no more rows
than the codebooks have numbers. At the end codes and errors of the distinct
parts are joined back to the vectors. All sums are exact integers.

Defined results: a row whose vector is null or holds null, NaN or an infinity is
dropped. Vectors that are shorter than the longest one (rounded up to whole
parts) are filled with zeros, an empty one wholly. Integers beyond +-2^27 count
as +-2^27, so that an error always is a long; sums in codebooks do not overflow.
Codebooks start from the smallest vec_ids, null last, rows of one vec_id by
their integers; a table of fewer rows has shorter codebooks, an empty one gives
no rows. Rows that repeat, or share a vec_id, keep a row each. Other columns,
whatever their names, are neither read nor returned; labels may be null.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

#: Largest magnitude of an integer: 2^6 squared differences of 2^28 and a few more fit a long.
MOST = 1 << 27
#: Integers are summed as high and low halves, each below 2^14 in magnitude or so, times a weight.
HALF = 14
#: Rows of a table up to which it is broadcast to a join; a larger one is shuffled.
FEW = 1 << 16


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, in doubles, where a product with a power of two is exact."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x.cast("double") * F.lit(float(scale))))).cast("int"))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _parts(ints: Column, parts: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(ints, p * width + 1, width))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the nearest row of book, the first of equally near ones, and the squared distance."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for j, entry in enumerate(book):
        d = x - entry
        d = np.einsum("ij,ij->i", d, d)
        closer = d < best
        best[closer], at[closer] = d[closer], j
    return at, best


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return batch["pos"].to_numpy(), batch["part"].flatten().to_numpy().reshape(-1, width).astype(np.int64)


def _sums(books: list[np.ndarray], width: int):
    """For each position, entry and component: the weight of the parts that are nearest, and their weighted sum in two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k = len(books), max((len(b) for b in books), default=0)
        low, high, weight = np.zeros((n, k, width), np.int64), np.zeros((n, k, width), np.int64), np.zeros((n, k), np.int64)
        for batch in batches:
            pos, x = _read(batch, width)
            w = batch["weight"].to_numpy()
            for p in np.unique(pos):
                own = pos == p
                at, _ = nearest(x[own], books[p])
                hot = (at == np.arange(k)[:, None]) * w[own]
                weight[p] += hot.sum(1)
                low[p] += hot @ (x[own] & ((1 << HALF) - 1))
                high[p] += hot @ (x[own] >> HALF)
        p, j, i = (a.ravel() for a in np.indices(low.shape))
        used = weight[p, j] > 0
        cols = {"pos": p, "entry": j, "i": i, "weight": weight[p, j], "low": low.ravel(), "high": high.ravel()}
        yield pa.RecordBatch.from_pydict({c: pa.array(v[used], pa.int64()) for c, v in cols.items()})

    return run


def _codes(books: list[np.ndarray], width: int):
    """Distinct parts with their entry and its squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, x = _read(batch, width)
            entry, error = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
            for p in np.unique(pos):
                own = pos == p
                entry[own], error[own] = nearest(x[own], books[p])
            yield pa.RecordBatch.from_arrays([batch["pos"], batch["part"], pa.array(entry), pa.array(error)], ["pos", "part", "entry", "error"])

    return run


class Compressed:
    """codes: vec_id, label, code, error; books: the final codebooks, an array (entries, width) for each part."""

    def __init__(self, codes: DataFrame, books: list[np.ndarray], scratch: Scratch):
        self.codes, self.books, self.scratch = codes, books, scratch

    def sha256(self) -> str:
        """Of all entries' integers by part, entry and place, decimal, joined by commas."""
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()

    def decoded(self, code: Column) -> Column:
        """The integers that a code stands for."""
        books = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in b]) for b in self.books])
        at = lambda p: F.conv(F.substring(code, p * 2 + 1, 2), 16, 10).cast("int")
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(self.books) - 1)), lambda p: books[p][at(p)]))


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096) -> Compressed:
    """vectors (vec_id, embedding, label) as codes of two hex digits a part; entries is 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-codes")
    kept = vectors.where(usable(F.col("embedding"))).select("vec_id", "label", integers(F.col("embedding"), scale).alias("ints"))
    rows = scratch.keep(kept.withColumn("row", F.monotonically_increasing_id()), "rows")
    longest = rows.agg(F.max(F.size("ints"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    filled = F.concat("ints", F.array_repeat(F.lit(0), F.lit(parts * width) - F.size("ints")))
    cut = rows.select("row", "vec_id", "label", _parts(filled, parts, width).alias("parts"))
    first = rows.select("vec_id", filled.alias("ints")).orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    start = np.array([r["ints"] for r in first], np.int64).reshape(-1, parts, width)
    books = [start[:, p].copy() for p in range(parts)]
    distinct = scratch.keep(cut.select(F.posexplode("parts").alias("pos", "part")).groupBy("pos", "part").agg(F.count("*").alias("weight")), "distinct")
    if first:
        for _ in range(rounds):
            found = distinct.mapInArrow(_sums(books, width), "pos long, entry long, i long, weight long, low long, high long")
            for r in found.groupBy("pos", "entry", "i").agg(*[F.sum(c).alias(c) for c in ("weight", "low", "high")]).collect():
                books[r["pos"]][r["entry"], r["i"]] = (r["low"] + (r["high"] << HALF)) // r["weight"]
    codes = scratch.keep(distinct.mapInArrow(_codes(books, width), "pos int, part array<int>, entry long, error long"), "codes")
    back = cut.select("row", "vec_id", "label", F.posexplode("parts").alias("pos", "part")).join(codes, ["pos", "part"])
    back = back.groupBy("row", "vec_id", "label").agg(F.array_sort(F.collect_list(F.struct("pos", F.lpad(F.lower(F.hex("entry")), 2, "0").alias("digits")))).alias("digits"), F.sum("error").alias("error"))
    back = scratch.keep(back.select("vec_id", "label", F.array_join("digits.digits", "").alias("code"), "error"), "coded")
    scratch.close("coded")
    return Compressed(back, books, scratch)


def compressed(vectors: DataFrame, **settings) -> DataFrame:
    """Per vector its code, its error, the error of all vectors of its label (nulls are one label), and the codebooks' digest."""
    made = compress(vectors, **settings)
    sums = made.scratch.keep(made.codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    x, y = made.codes.alias("x"), (F.broadcast(sums) if sums.count() <= FEW else sums).alias("y")
    joined = x.join(y, F.col("x.label").eqNullSafe(F.col("y.label")))
    return joined.select("x.vec_id", "x.code", "x.error", "y.label_error", F.lit(made.sha256()).alias("codebooks_sha256"))
