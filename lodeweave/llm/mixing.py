"""Mixing sources to target weights by Pareto order sampling, on DataFrame operations only.

Sources in code-point order (null last) carry the weights 5, 2, 1, repeating,
and share ``budget`` times all words; a target stops at ``cap`` times its
source's size and what is left goes to the others by weight. This division is a
water level: sources sorted by cap * size / weight, the first k of them capped.

Within a source a document is to be copied a times on average, a in proportion
to a preference of its length class and at most ``cap``; the factor that makes
the source meet its target is a second water level, over the few length classes.
floor(a) copies are certain; the rest, pi = a - floor(a), is the inclusion
probability of one more copy. Pareto order sampling ranks documents by
(u / (1 - u)) / (pi / (1 - pi)), u from a seeded hash of the row, and takes
them in that order until the words that the certain copies leave are used up: a
sample of fixed size in words, with unequal probabilities.

The rank is cut by a two-step prefix sum: rows are dealt into fine buckets of
the ranking variable, the buckets' word counts (a small table) tell in which
bucket of each source the cut falls, and only that bucket's rows are ordered.

Defined results: null text has size 0 and is never taken; null sources are one
source, the last; very long texts count whole; an empty table gives no rows; other
columns, of whatever name, stay as they are. Rows that are equal in source,
doc_id and text are numbered, each with a draw of its own, so that the cut can
fall between them; which of them has which number does not matter, as they are
alike. Reruns agree, as nothing but the rows and the seed decides.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import FEW, durable, fresh, placed, repeats, stored
from .sharding import same_all

#: Weights of sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def size_of(text) -> F.Column:
    """Number of runs of characters other than space and \\t..\\r; null has none."""
    # a run starts where a word character follows a separator or the text's start
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """sizes (s, source_size) with target."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("s").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("level", cap * F.col("source_size") / F.col("w"))
    order = Window.orderBy(F.col("level"), F.col("s").asc_nulls_last())
    x = x.withColumn("total", F.sum("source_size").over(everything) * budget)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # lam: words per weight if all sources before this one are capped and none from it on
    x = x.withColumn("lam", (F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after))
    x = x.withColumn("lam", F.min(F.when(F.col("lam") <= F.col("level"), F.struct("level", "lam"))).over(everything)["lam"])
    full = cap * F.col("source_size")
    return x.select("s", "source_size", F.when(F.col("lam").isNull(), full).otherwise(F.least(full, F.col("lam") * F.col("w"))).cast("double").alias("target"))


def rates(classes: DataFrame, cap: float) -> DataFrame:
    """classes (s, cls, pref, words, target) with a, the mean copies of a class: min(cap, lam * pref) with words * a adding up to target."""
    falling = Window.partitionBy("s").orderBy(F.col("pref").desc(), "cls")
    before = falling.rowsBetween(Window.unboundedPreceding, -1)
    after = falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = classes.withColumn("lam", F.try_divide(F.col("target") - cap * F.coalesce(F.sum("words").over(before), F.lit(0)), F.sum(F.col("words") * F.col("pref")).over(after)))
    ok = F.col("lam") * F.col("pref") <= F.lit(cap) * (1 + 1e-12)
    x = x.withColumn("lam", F.max(F.when(ok, F.struct("pref", "lam"))).over(Window.partitionBy("s"))["lam"])
    return x.withColumn("a", F.when(F.col("lam").isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.greatest(F.lit(0.0), F.col("lam") * F.col("pref")))))


class Plan:
    """The decisions of a mix as two small tables, by which any row's copies follow from its source, size and hash alone."""

    def __init__(self, measured: DataFrame, weights=WEIGHTS, budget=1.0, cap=3.0, tilt=0.1, buckets=None):
        """measured: s, size, h. tilt: preference per doubling of length over classes from 2^4 to 2^12 words (0: all alike). buckets: of the ranking variable in a source, by default as many as a bucket of the largest possible source has rows, so that neither grows faster than the root of the input."""
        buckets = buckets or max(4096, math.isqrt(measured.count()))
        measured = measured.withColumn("cls", _class(F.col("size")))
        classes = measured.groupBy("s", "cls").agg(F.sum("size").alias("words"))
        sizes = targets(classes.groupBy("s").agg(F.sum("words").alias("source_size")), weights, budget, cap)
        x, y = classes.alias("x"), sizes.alias("y")
        classes = x.join(y, same_all(x, y, ["s"])).select("x.*", "y.source_size", "y.target").withColumn("pref", F.lit(1.0) + F.lit(tilt) * (F.col("cls") - 4))
        classes = rates(classes, cap).withColumn("whole", F.floor(F.col("a") + 1e-9)).withColumn("pi", F.greatest(F.lit(0.0), F.col("a") - F.col("whole")))
        left = F.sum(F.col("words") * F.col("pi")).over(Window.partitionBy("s"))
        self.classes = durable(classes.select("s", "cls", "source_size", "target", "whole", "pi", left.alias("left")), "mix-classes")
        drawn = self._join(measured).withColumn("xi", _xi(F.col("h"), F.col("pi"))).where(F.col("pi").isNotNull() & (F.col("pi") > 0) & (F.col("size") > 0))
        drawn = drawn.select("s", "size", "xi", "left", F.least(F.lit(buckets - 1), F.floor(F.col("xi") * buckets)).alias("b"))
        sums = drawn.groupBy("s", "b").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("b"))
        edges = durable(sums.withColumn("before", upto - F.col("words")).withColumn("upto", upto).where((F.col("before") < F.col("left")) & (F.col("upto") >= F.col("left"))).select("s", "b", "before"), "mix-edges")
        # the rows of the one bucket of each source in which the cut falls, in exact order
        x, y = drawn.alias("x"), edges.alias("y")
        edge = x.join(y, F.col("x.s").eqNullSafe(F.col("y.s")) & (F.col("x.b") == F.col("y.b"))).select("x.s", "x.size", "x.xi", "x.left", "y.before")
        begin = F.sum("size").over(Window.partitionBy("s").orderBy("xi").rowsBetween(Window.unboundedPreceding, -1))
        edge = edge.withColumn("begin", F.col("before") + F.coalesce(begin, F.lit(0)))
        last = edge.where(F.col("begin") + F.col("size") / 2 <= F.col("left")).groupBy("s").agg(F.max("xi").alias("cut"))
        x, y = edges.alias("x"), last.alias("y")
        floor = (F.col("x.b") / F.lit(float(buckets))).cast("double")
        self.cuts = durable(x.join(y, same_all(x, y, ["s"]), "left").select(F.col("x.s").alias("s"), F.coalesce(F.col("y.cut"), floor).alias("cut")), "mix-cuts")

    def _join(self, df: DataFrame) -> DataFrame:
        x, y = df.alias("x"), self.classes.alias("y")
        return x.join(y, F.col("x.s").eqNullSafe(F.col("y.s")) & (F.col("x.cls") == F.col("y.cls"))).select("x.*", "y.source_size", "y.target", "y.whole", "y.pi", "y.left")

    def apply(self, df: DataFrame) -> DataFrame:
        """df (s, size, h, ...) with source_size, target and copies."""
        df = self._join(df.withColumn("cls", _class(F.col("size"))))
        x, y = df.alias("x"), self.cuts.alias("y")
        df = x.join(y, same_all(x, y, ["s"]), "left").select("x.*", "y.cut")
        more = (F.col("pi") > 0) & (_xi(F.col("h"), F.col("pi")) <= F.coalesce(F.col("cut"), F.lit(1.0)))
        return df.withColumn("copies", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") + more.cast("int")).cast("int")).drop("cls", "cut", "whole", "pi", "left")


def _class(size) -> F.Column:
    """Length class: the binary logarithm of the size, 4 to 12, so that a source has nine classes at most."""
    return F.least(F.lit(12), F.greatest(F.lit(4), F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")))


def _xi(h, pi) -> F.Column:
    """xi / (1 + xi) for xi = (u / (1 - u)) / (pi / (1 - pi)): the same order, but in (0, 1)."""
    u = (F.shiftrightunsigned(h, 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    odds = u * (1 - pi)
    return F.when(pi > 0, odds / (odds + (1 - u) * pi))


def _hash(seed: int) -> F.Column:
    return F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id"), F.col("text"))


def _draw(h, copy, seed: int) -> F.Column:
    """The hash that a row draws by: that of its key, and for further copies one with their number."""
    return F.when(copy > 0, F.xxhash64(F.lit(seed), h, copy)).otherwise(h)


def _drawn(rows: DataFrame, found: DataFrame | None, place: list[str], seed: int) -> DataFrame:
    """rows (h, the hash of a key) with h, each row's draw; found: the numbers of rows that repeat, see repeats()."""
    if found is None:
        return rows
    x, y = rows.alias("x"), (F.broadcast(found) if found.count() <= FEW else found).alias("y")
    joined = x.join(y, F.expr(" AND ".join(f"x.`{c}` = y.`{c}`" for c in place)), "left")
    return joined.select(*[F.col(f"x.`{c}`") for c in rows.columns if c != "h"], _draw(F.col("x.h"), F.coalesce("y.copy", F.lit(0)), seed).alias("h"))


def _repeats(measured: DataFrame, place: list[str]) -> DataFrame | None:
    found = repeats(measured, "h", place)
    return None if found is None else durable(found, "mix-repeats")


def mix(docs: DataFrame, seed: int = 0, **settings) -> DataFrame:
    """Per document its size, its source's size and target, copies, and the words that the mix takes from it."""
    measured = docs.select("doc_id", F.col("source").alias("s"), size_of(F.col("text")).alias("size"), _hash(seed).alias("h"), F.monotonically_increasing_id().alias("place"))
    measured = durable(measured, "mix-measured")
    measured = _drawn(measured, _repeats(measured, ["place"]), ["place"], seed)
    out = Plan(measured, **settings).apply(measured)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", F.col("s").alias("source"))


def mixed(docs: DataFrame, seed: int = 0, **settings) -> DataFrame:
    """The mix itself: every document as often as it is to be copied, with the columns of docs. docs that are not files are written first."""
    docs = docs if stored(docs) else durable(docs, "mix-rows")
    own = {"part": fresh(docs, "part"), "at": fresh(docs, "at")}
    place, whole = list(own), placed(docs, *own.values())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = whole.select(row, F.col("source").alias("s"), size_of(F.col("text")).alias("size"), _hash(seed).alias("h"), *[F.col(c).alias(n) for n, c in own.items()])
    measured = durable(rows.drop("row"), "mix-measured")
    found = _repeats(measured, place)
    plan, rows = Plan(_drawn(measured, found, place, seed), **settings), _drawn(rows, found, place, seed)
    chosen = plan.apply(rows).where(F.col("copies") > 0)
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
