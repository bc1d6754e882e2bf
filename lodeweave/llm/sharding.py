"""Sharding by proportional stratified interleaving, on DataFrame operations.

Rows of each source are put in a seeded random order; the row of rank r among n
has the fractional rank (2r - 1) / 2n. All rows in the order of their
fractional ranks are cut into equal runs, the shards: every shard then holds
each source in its share of the whole, and shard sizes are at most one apart.

Ranks over a source (and over the whole) are not taken in one task. Rows are
dealt into fine buckets of the ordering key, ranked inside their bucket, and the
buckets' row counts, a small table, give the offsets. The number of buckets
follows the row count, so a bucket has about ``per_bucket`` rows whatever the
size, and a hot source only has more buckets.

Null sources form a source of their own; null texts have size 1. Rows that are
equal in every column used here are interchangeable, so any order of them gives
the same result. Of a key that very many rows repeat each row has a number, which the hash takes in, so that they too
are dealt over the buckets. Very long texts count by their size and checksum only. Other columns, whatever their names,
are not read by ``shard_listing`` and handed on by ``sharded``. An empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import durable, fresh, placed, repeats, stored


def _rank(df: DataFrame, groups: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Adds the 1-based rank by (bucket, *order) within groups, a long; bucket must not fall as the order goes on."""
    b, n, before = fresh(df, "b"), fresh(df, "n"), fresh(df, "before")
    df = df.withColumn(b, bucket)
    counts = df.groupBy(*groups, b).agg(F.count("*").alias(n))
    # offsets by prefix sums over blocks of buckets, then within a block: neither window holds more than the square root of the buckets
    block = fresh(df, "block")
    counts = counts.withColumn(block, F.floor(F.col(b) / F.lit(_BLOCK)))
    sums = counts.groupBy(*groups, block).agg(F.sum(n).alias("s_"))
    sums = sums.select(*groups, block, (F.sum("s_").over(Window.partitionBy(*groups).orderBy(block)) - F.col("s_")).alias("o_"))
    x, y = counts.alias("x"), sums.alias("y")
    counts = x.join(y, same_all(x, y, [*groups, block]), "inner").select(*[F.col(f"x.{g}").alias(g) for g in groups], F.col(f"x.{b}").alias(b), F.col(f"x.{block}").alias(block), F.col(f"x.{n}").alias(n), F.col("y.o_").alias("o_"))
    within = F.sum(n).over(Window.partitionBy(*groups, block).orderBy(b)) - F.col(n) + F.col("o_")
    offsets = counts.select(*groups, b, within.alias(before))
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*groups, b).orderBy(*order)).cast("long"))
    x, y = ranked.alias("x"), offsets.alias("y")
    joined = x.join(y, same_all(x, y, [*groups, b]), "inner")
    return joined.select(*[F.col(f"x.`{c}`").alias(c) for c in df.columns if c != b], (F.col(f"x.{out}") + F.col(f"y.{before}")).alias(out))


_BLOCK = 1024


def same_all(x: DataFrame, y: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of all keys of two aliased frames x and y."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"x.`{k}`").eqNullSafe(F.col(f"y.`{k}`"))
    return out


def interleave(df: DataFrame, shards: int, key: list[Column], source: str = "source", seed: int = 0, per_bucket: int = 2000, total: int | None = None, ties: tuple[Column, ...] = ()) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 in each shard). key: what the seeded order hashes; ties: what orders rows of one key, where they have to be told apart."""
    total = df.count() if total is None else total
    buckets = max(1, -(-total // per_bucket))
    u, s, rank, size, frac, pos = (fresh(df, x) for x in ("u", "s", "rank", "size", "frac", "pos"))
    # a seeded shuffle: the order of a hash, as a number in [0, 1)
    df = df.withColumn(u, F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / F.lit(float(1 << 53))).withColumn(s, F.col(source))
    sizes = df.groupBy(s).agg(F.count("*").alias(size))
    df = _rank(df, [s], F.floor(F.col(u) * buckets), [F.col(u), *key, *ties], rank)
    x, y = df.alias("x"), sizes.alias("y")
    df = x.join(y, same_all(x, y, [s]), "inner").select("x.*", F.col(f"y.{size}").alias(size))
    df = df.withColumn(frac, (F.col(rank) * 2 - 1) / (F.col(size) * 2))
    df = _rank(df, [], F.floor(F.col(frac) * buckets), [F.col(frac), F.col(s).asc_nulls_last(), F.col(u), *key, *ties], pos)
    # runs: the first total % shards shards have one row more
    small, more = divmod(total, shards)
    p, edge = F.col(pos) - 1, more * (small + 1)
    shard = F.when(p < edge, F.floor(p / (small + 1))).otherwise(more + F.floor((p - edge) / max(small, 1)))
    start = F.when(F.col("shard") <= more, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - more) * small)
    out = df.withColumn("shard", shard.cast("int"))
    return out.withColumn("slot", (p - start).cast("long")).drop(u, s, rank, size, frac, pos)


#: Rows of one key beyond which each of them is hashed with a number of its own.
REPEATS = 500


def _told_apart(rows: DataFrame, key: list[Column], place: list[str]) -> tuple[DataFrame, str]:
    """rows, a table, with a column, here named, that numbers the rows of each key that more than REPEATS rows have (0 elsewhere)."""
    k, copy = fresh(rows, "k"), fresh(rows, "copy")
    hashed = rows.withColumn(k, F.xxhash64(*key))
    found = repeats(hashed, k, place, REPEATS)
    if found is None:
        return rows.withColumn(copy, F.lit(0).cast("long")), copy
    found = durable(found.select(*place, F.col("copy").alias(copy)), "shard-repeats")
    return rows.join(found, place, "left").na.fill(0, [copy]), copy


def _measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))


def shard_listing(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Per document its shard and slot, under the law of row counts."""
    measured = durable(_measured(docs).withColumn("place", F.monotonically_increasing_id()), "shard-measured")
    key = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    rows, copy = _told_apart(measured, [F.col("source"), *key], ["place"])
    out = interleave(rows, shards, [*key, F.col(copy)], seed=seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def sharded(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """docs with the columns shard and slot; columns of these names are replaced.

    Ranks are taken on source and a hash of each row's key. Every row has a place, its file and its number there (docs
    that are not files are written first), and is shuffled once, by its place; rows that repeat have places of their own."""
    rows = docs if stored(docs) else durable(docs, "shard-rows")
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    part, at = fresh(rows, "part"), fresh(rows, "at")
    whole = placed(rows, part, at)
    narrow = durable(whole.select(part, at, F.col("source").alias("s"), "doc_id", F.xxhash64("text").alias("h")), "shard-narrow")
    narrow, copy = _told_apart(narrow, [F.col("s"), F.col("doc_id"), F.col("h")], [part, at])
    # rows of one key are told apart by their places, so that a task that runs again ranks them as before
    listing = interleave(narrow, shards, [F.col("doc_id"), F.col("h"), F.col(copy)], source="s", seed=seed, ties=(F.col(part), F.col(at))).select(part, at, "shard", "slot")
    listing = durable(listing, "shard-listing")
    x, y = whole.alias("x"), listing.alias("y")
    on = (F.col(f"x.{part}") == F.col(f"y.{part}")) & (F.col(f"x.{at}") == F.col(f"y.{at}"))
    return x.join(y, on).select(*[F.col(f"x.`{c}`") for c in kept], "y.shard", "y.slot")
