"""Exact nearest neighbours over stored cells, pruned by the triangle inequality.

Vectors belong to the cell of their nearest pivot and are stored in blocks of one cell, ordered by their distance r from
it. With d the distance from a query to the pivot, no vector of the cell is nearer than |d - r|, and none is nearer than
half of what d exceeds the distance to the query's own pivot by. A search meets a query's own cell first; the k-th
distance found there is a bound, and of all other cells only the blocks, and of these only the ring of radii, that can
hold something nearer are met. Queries and blocks meet in one join by cell, however many queries there are.

Cosine distance is searched as the distance of unit vectors, whose square is twice as large; it and the plain distance
are both metrics, so the result equals that of all distances.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut
from .search import _distances, apart, ranked
from .stored import FileIndex, batches_of

#: Slack of bounds, far above the error of a distance.
SLACK = 1e-7
#: Vectors that a task sorts into blocks at a time, and queries that meet a block at a time.
HELD, ASKED = 1 << 15, 256


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return x
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(x: np.ndarray, many: int) -> np.ndarray:
    """Pivots: the vector nearest to the mean, then always the one that is farthest from all so far."""
    if not len(x):
        return x
    out = [int(apart(x, x.mean(axis=0, keepdims=True)).argmin())]
    left = apart(x, x[out])[:, 0]
    while len(out) < many and left.max() > 0:
        out.append(int(left.argmax()))
        left = np.minimum(left, apart(x, x[out[-1:]])[:, 0])
    return x[out]


def _array(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64).reshape(-1, dim)


class CellIndex(FileIndex):
    """The vectors of one Parquet table by cells. pivots: how many; sample: of how many vectors, those of smallest hash, they are chosen.

    Vectors that are null, hold a null or a number that is not finite, or (for cosine) have length 0 are nobody's neighbours."""

    def __init__(self, spark: SparkSession, path: str, key: str, vector: str, metric: str = "cosine", pivots: int = 128, sample: int = 4096, base: str | None = None):
        self.key, self.vector, self.metric, self.pivots, self.sample = key, vector, metric, pivots, sample
        super().__init__(spark, path, "cells", repr((key, vector, metric, pivots, sample)), base)
        self.kind = spark.read.parquet(path).schema[key].dataType
        self.schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("cell", T.LongType()), T.StructField("least", T.DoubleType()), T.StructField("most", T.DoubleType()), T.StructField("ids", T.ArrayType(self.kind)), T.StructField("radii", T.BinaryType()), T.StructField("vectors", T.BinaryType())])

    def _usable(self):
        v = F.col(self.vector)
        sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return sound & F.exists(v, lambda x: x != 0) if self.metric == "cosine" else sound

    def _chosen(self, rows: DataFrame | None = None) -> np.ndarray:
        """The pivots, chosen at the first build and the same for all later ones."""
        fs, at = self._at("pivots/_SUCCESS")
        if not fs.exists(at):
            if rows is None:
                return np.zeros((0, 1))
            few = rows.where(self._usable()).orderBy(F.xxhash64(F.col(self.key).cast("string")), F.col(self.key)).limit(self.sample).select(F.col(self.vector).alias("v")).collect()
            x = _unit(np.array([r["v"] for r in few], dtype=np.float64), self.metric) if few else np.zeros((0, 1))
            kept = [(i, [float(v) for v in p]) for i, p in enumerate(spread(x, self.pivots))]
            self.spark.createDataFrame(kept, "cell long, pivot array<double>").coalesce(1).write.mode("ignore").parquet(f"{self.base}/pivots")
        got = self.spark.read.schema("cell long, pivot array<double>").parquet(f"{self.base}/pivots").orderBy("cell").collect()
        return np.array([r["pivot"] for r in got], dtype=np.float64) if got else np.zeros((0, 1))

    def build(self, rows: DataFrame, target: str) -> None:
        pivots, metric = self._chosen(rows), self.metric
        dim = pivots.shape[1]

        def blocks(file: str, ids: list, x: np.ndarray) -> pd.DataFrame:
            d = apart(_unit(x, metric), pivots)
            cell = d.argmin(axis=1)
            r = d[np.arange(len(x)), cell]
            order = np.lexsort((r, cell))
            out = []
            for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                out.append((file, int(cell[own[0]]), float(r[own[0]]), float(r[own[-1]]), [ids[i] for i in own], r[own].tobytes(), x[own].tobytes()))
            return pd.DataFrame(out, columns=["file", "cell", "least", "most", "ids", "radii", "vectors"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[str, tuple[list, list]] = {}
            for pdf in batches:
                for file, part in pdf.groupby("file", sort=False):
                    ids, xs = held.setdefault(file, ([], []))
                    ids += part["id"].tolist()
                    xs.append(_array(part["v"], dim))
                    if len(ids) >= HELD:
                        yield blocks(file, ids, np.concatenate(xs))
                        del held[file]
            for file, (ids, xs) in held.items():
                yield blocks(file, ids, np.concatenate(xs))

        sound = rows.where(self._usable()).select("file", F.col(self.key).alias("id"), F.col(self.vector).alias("v"))
        with batches_of(self.spark, 4096):
            (sound if len(pivots) else sound.limit(0)).mapInPandas(run, self.schema).write.parquet(target)

    # -- searching --------------------------------------------------------------

    def _met(self, asked: DataFrame, kind: T.DataType, k: int) -> DataFrame:
        """The k nearest of each block for each query that asks (query_id, cell, low, high, query) for its cell; looked: vectors whose distance was found."""
        metric = self.metric
        out = T.StructType([T.StructField("query_id", kind), T.StructField("id", self.kind), T.StructField("distance", T.DoubleType()), T.StructField("looked", T.LongType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for ids, radii, vectors, asks in zip(pdf["ids"], pdf["radii"], pdf["vectors"], pdf["asks"], strict=True):
                    r = np.frombuffer(radii)
                    x = np.frombuffer(vectors).reshape(len(r), -1)
                    low, high = (np.array([a[c] for a in asks]) for c in ("low", "high"))
                    first, last = np.searchsorted(r, low), np.searchsorted(r, high, "right")
                    lo, hi = int(first.min()), int(last.max())
                    if lo >= hi:
                        continue
                    d = _distances(np.array([a["query"] for a in asks], dtype=np.float64), x[lo:hi], metric)
                    place = np.arange(lo, hi)
                    d = np.where((place >= first[:, None]) & (place < last[:, None]), d, np.inf)
                    names, many = np.array([ids[i] for i in place], dtype=object), min(k, hi - lo)
                    rows = []
                    for a, each, looked in zip(asks, d, last - first, strict=True):
                        near = np.lexsort((names, np.round(each, 12)))[:many]
                        near = near[np.isfinite(each[near])]
                        rows += [(a["query_id"], names[i], each[i], int(looked) if n == 0 else 0) for n, i in enumerate(near)]
                    if rows:
                        yield pd.DataFrame(rows, columns=["query_id", "id", "distance", "looked"])

        packed = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)))
        w = Window.partitionBy("cell", F.pmod("part", F.lit(64))).orderBy("part")
        packed = packed.withColumn("part", F.struct(F.pmod("part", F.lit(64)).alias("s"), F.floor((F.row_number().over(w) - 1) / ASKED).alias("n")))
        packed = packed.groupBy("cell", "part").agg(F.collect_list(F.struct("query_id", "low", "high", "query")).alias("asks"), F.min("low").alias("low"), F.max("high").alias("high"))
        x, y = self.table().alias("x"), packed.alias("y")
        pairs = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.most") >= F.col("y.low")) & (F.col("x.least") <= F.col("y.high")))
        with batches_of(self.spark, 16):
            # written inside the block, as the size of batches is read when a plan is run
            return cut(pairs.select("x.ids", "x.radii", "x.vectors", "y.asks").mapInPandas(run, out))

    def _found(self, queries: DataFrame, k: int) -> DataFrame:
        metric, pivots = self.metric, self._chosen()
        kind = queries.schema["query_id"].dataType
        ask = T.StructType([T.StructField("query_id", kind), T.StructField("cell", T.LongType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("query", T.ArrayType(T.DoubleType()))])
        extent = self.table().groupBy("cell").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()  # a row for each pivot
        near, far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for e in extent:
            near[e["cell"]], far[e["cell"]] = e["least"], e["most"]
        full = np.flatnonzero(np.isfinite(near))

        def asks(bounded: bool):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    if not len(pdf) or not len(full):
                        continue
                    q = _array(pdf["query"], pivots.shape[1])
                    d = apart(_unit(q, metric), pivots)
                    home = full[d[:, full].argmin(axis=1)]
                    if not bounded:
                        yield pd.DataFrame({"query_id": pdf["query_id"], "cell": home, "low": -np.inf, "high": np.inf, "query": pdf["query"]})
                        continue
                    bound = pdf["bound"].to_numpy(dtype=np.float64)
                    reach = np.sqrt(2 * np.maximum(0, bound)) if metric == "cosine" else bound
                    reach = np.where(np.isnan(reach), np.inf, reach) + SLACK * (1 + d.max(axis=1))
                    least = np.maximum.reduce([d - far, near - d, (d - d[np.arange(len(d)), home][:, None]) / 2])
                    ok = (least <= reach[:, None]) & np.isfinite(near)
                    ok[np.arange(len(d)), home] = False
                    row, cell = np.nonzero(ok)
                    mine = d[row, cell]
                    yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[row], "cell": cell, "low": mine - reach[row], "high": mine + reach[row], "query": pdf["query"].to_numpy()[row]})

            return run

        v = F.col("query")
        sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & (F.exists(v, lambda x: x != 0) if metric == "cosine" else F.lit(True))
        q = queries.where(sound).select("query_id", v.cast("array<double>").alias("query"))
        home = self._met(q.mapInPandas(asks(False), ask), kind, k)
        # the k-th distance of the own cell; without k vectors there it bounds nothing
        bound = ranked(home, [F.round("distance", 12), F.col("id")], k, ["query_id"]).where(F.col("rank") == k).select("query_id", (F.col("distance") + SLACK * SLACK * 1000).alias("bound"))
        rest = self._met(q.join(bound, "query_id", "left").mapInPandas(asks(True), ask), kind, k)
        return home.unionByName(rest)

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, key, distance, rank): the k nearest rows of each query (query_id, query), ordered to twelve digits, then by key."""
        found = self._found(queries, k).select("query_id", F.col("id").alias(self.key), "distance")
        return ranked(found, [F.round("distance", 12), F.col(self.key)], k, ["query_id"])

    def touched(self, queries: DataFrame, k: int) -> tuple[int, int]:
        """How many distances a search finds, and how many there are."""
        looked = self._found(queries, k).agg(F.sum("looked")).first()[0] or 0
        return looked, queries.count() * (self.table().agg(F.sum(F.size("ids"))).first()[0] or 0)
