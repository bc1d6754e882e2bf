"""Merkle dataset manifest with a broadcast upper tree.

Every row is a leaf, the SHA-256 of its fields, each with its length before it.
Leaves of a source ascend by doc_id; runs of ``FAN`` consecutive nodes become the
digest of their digests until one is left, the source's subroot, and subroots in
the order of their sources make the root in the same way.

Leaves are placed by one range sort, so a source of any share has as many
places as it needs, and blocks of FAN ** height consecutive leaves go to one
task each, which leaves one node a block. Where more than ``bound`` nodes are
left the same is done with them again, and with the subroots where sources are
that many. The driver builds the tree over the last ``bound`` nodes at most and
broadcasts the path above each (levels x 15 digests); blocks are read again,
with no further shuffle of rows where one reduction was enough, and their tasks
finish every row's siblings and fold a present state of the row to a root.

Defined results: a null field is written '-', an empty text '0:'. Null sources
are one source, the first; null doc_ids come first in their source and are not
tampered with; rows that share a doc_id stand in the order of their leaves, equal
rows have places of their own. Long texts are hashed whole. Columns besides the
five are not part of a leaf, whatever their names. An empty table has no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ._common import Scratch, list_of, row_type, small_batches
from .sharding import same_all

#: Nodes of a run, and characters of a digest.
FAN, WIDE = 16, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a table up to which it is broadcast to a join; a larger one is shuffled.
FEW = 1 << 16
#: Blocks that a Python worker holds at a time.
BLOCKS = 16


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The digest of fields, each '-' or its length in bytes, ':' and itself."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]), 256)


def levels(nodes: int) -> int:
    """Levels from so many nodes to one."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // FAN), n + 1
    return n


def above(nodes: int, up: int) -> int:
    for _ in range(up):
        nodes = -(-nodes // FAN)
    return nodes


def runs(digests: list[str], up: int) -> tuple[list[list[str]], str]:
    """The joined runs of each of ``up`` levels over digests, and the first node above them."""
    out, now = [], list(digests)
    for _ in range(up):
        out.append(["".join(now[i : i + FAN]) for i in range(0, len(now), FAN)])
        now = [digest(x) for x in out[-1]]
    return out, now[0]


def siblings(of: list[list[str]], i: int) -> list[tuple[str, str]]:
    """What stands left and right of node i and of the nodes above it, a pair for each level."""
    out = []
    for level in of:
        run, at = level[i // FAN], i % FAN * WIDE
        out.append((run[:at], run[at + WIDE :]))
        i //= FAN
    return out


def fold(start: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf has with its siblings."""
    for left, right in path:
        start = digest(left + start + right)
    return start


_PATH = list_of(row_type(l="string", r="string"))
_PLACE = row_type(tree="string", idx="long", subroot="string", path=_PATH)


def _placed(df: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """df as a table with ``at``, which ascends with the order: the number of a partition, and of the row in it."""
    # the sort's columns tell any two rows apart that differ in anything, so a task that runs again gives the same
    return scratch.keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)


def _numbered(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """placed (tree, at, ...), where each tree's rows are consecutive, with idx from 0 and the tree's n."""
    part = F.shiftright("at", 33)
    stats = placed.groupBy("tree", part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    whole = Window.partitionBy("tree")
    stats = stats.select("tree", "part", "first", (F.sum("rows").over(whole.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(whole).alias("n"))
    stats = scratch.keep(stats, "places")
    x, y = placed.withColumn("part", part).alias("x"), (F.broadcast(stats) if stats.count() <= FEW else stats).alias("y")
    kept = [F.col(f"x.{c}") for c in placed.columns if c != "at"]
    return x.join(y, same_all(x, y, ["tree", "part"])).select(*kept, (F.col("x.at") - F.col("y.first") + F.col("y.before")).alias("idx"), "y.n")


def _blocks(nodes: DataFrame, carried: list[str], height: int, scratch: Scratch, name: str) -> DataFrame:
    """nodes (tree, idx, n, digest, ...) as a table with a row for each FAN ** height of them: tree, block, n and lists in their order."""
    size = FAN**height
    b = nodes.groupBy("tree", F.expr(f"idx div {size}").alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest", *carried))).alias("m"))
    return scratch.keep(b.select("tree", "block", "n", *[F.col(f"m.{c}").alias(c) for c in ("digest", *carried)]), name)


def _reduced(blocks: DataFrame, height: int, scratch: Scratch, name: str) -> DataFrame:
    """One node for each block: tree, idx, n, digest."""

    @pandas_udf("string")
    def node(digests: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([runs(list(d), min(height, levels(k)))[1] for d, k in zip(digests, n, strict=True)], dtype=object)

    @pandas_udf("long")
    def left(n: pd.Series) -> pd.Series:
        return n.map(lambda k: above(k, min(height, levels(k))))

    return scratch.keep(blocks.select("tree", F.col("block").alias("idx"), left("n").alias("n"), node("digest", "n").alias("digest")), name)


def build(trees: dict[str | None, list[str]]) -> tuple[str, list[tuple]]:
    """The root over trees of digests, and for each digest (tree, idx, subroot, path)."""
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    inner = {t: runs(trees[t], levels(len(trees[t]))) for t in names}
    tops = [inner[t][1] for t in names]
    outer, root = runs(tops, levels(len(tops)))
    return root, [(t, i, tops[k], siblings(inner[t][0], i) + siblings(outer, k)) for k, t in enumerate(names) for i in range(len(trees[t]))]


def _ways(nodes: DataFrame, height: int, bound: int, scratch: Scratch, depth: int = 0) -> tuple[str, DataFrame]:
    """The root over nodes (tree, idx, n, digest), a table, and for each node the subroot of its tree and the path above the node: tree, idx, subroot, path."""
    spark, name = nodes.sparkSession, f"up{depth}"
    if nodes.count() <= bound:
        trees: dict[str | None, list[str]] = {}
        for r in sorted(nodes.select("tree", "idx", "digest").collect(), key=lambda r: r["idx"]):
            trees.setdefault(r["tree"], []).append(r["digest"])
        if not trees:
            return digest(""), spark.createDataFrame([], _PLACE)
        root, rows = build(trees)
        return root, F.broadcast(spark.createDataFrame(rows, _PLACE))
    if nodes.where("n > 1").isEmpty():
        # every tree is down to its subroot, and there are many: they are the leaves of one tree, in the order of their names
        placed = _placed(nodes.select(F.col("tree").alias("was"), F.lit("").alias("tree"), "digest"), ["was"], scratch, f"{name}-order")
        tops = scratch.keep(_numbered(placed, scratch), f"{name}-tops")
        root, ways = _ways(tops.select("tree", "idx", "n", "digest"), height, bound, scratch, depth + 1)
        x, y = tops.alias("x"), ways.alias("y")
        return root, x.join(y, F.col("x.idx") == F.col("y.idx")).select(F.col("x.was").alias("tree"), F.lit(0).cast("long").alias("idx"), F.col("x.digest").alias("subroot"), "y.path")
    blocks = _blocks(nodes, [], height, scratch, f"{name}-blocks")
    root, ways = _ways(_reduced(blocks, height, scratch, f"{name}-nodes"), height, bound, scratch, depth + 1)

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                own, _ = runs(list(r.digest), min(height, levels(r.n)))
                over = [(p["l"], p["r"]) for p in r.path]
                paths = [[{"l": a, "r": b} for a, b in siblings(own, i) + over] for i in range(len(r.digest))]
                yield pd.DataFrame({"tree": r.tree, "idx": [r.block * FAN**height + i for i in range(len(paths))], "subroot": r.subroot, "path": paths})

    return root, scratch.keep(_met(blocks, ways).mapInPandas(down, _PLACE), f"{name}-ways")


def _met(blocks: DataFrame, ways: DataFrame) -> DataFrame:
    """blocks with the subroot and the path above each."""
    x, y = blocks.alias("x"), ways.alias("y")
    return x.join(y, F.col("x.tree").eqNullSafe(F.col("y.tree")) & (F.col("x.block") == F.col("y.idx"))).select("x.*", "y.subroot", "y.path")


def manifest(docs: DataFrame, now: Column | None = None, height: int = 3, bound: int = 4096, paths: bool = False) -> DataFrame:
    """Per row its leaf, subroot, root and the digest of its siblings, and the root that its present text folds to with them.

    now: the text as it is found when the manifest is held against it (by default as it was); paths: also return the siblings
    themselves, a pair (l, r) of what stands left and right at each level."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "merkle")
    fields = [F.col(f) for f in FIELDS]
    was, found = leaf(*fields), leaf(*fields[:-1], F.col("text") if now is None else now)
    # a leaf that is as it was is stored once
    leaves = docs.select(F.col("source").alias("tree"), "doc_id", was.alias("digest"), F.nullif(found, was).alias("found"), F.monotonically_increasing_id().alias("tie"))
    leaves = scratch.keep(leaves, "leaves")
    placed = _placed(leaves, ["tree", "doc_id", "digest", "tie"], scratch, "placed").drop("tie")
    # as text from here on: a list of numbers with nulls among them is one of floats in Python
    placed = placed.withColumn("doc_id", F.col("doc_id").cast("string"))
    blocks = _blocks(_numbered(placed, scratch), ["doc_id", "found"], height, scratch, "blocks")
    scratch.drop("leaves", "placed", "places")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                own, _ = runs(list(r.digest), min(height, levels(r.n)))
                over, out = [(p["l"], p["r"]) for p in r.path], []
                for i, (was, found) in enumerate(zip(r.digest, r.found, strict=True)):
                    path = siblings(own, i) + over
                    folded = fold(found or was, path)
                    out.append((r.doc_id[i], was, r.subroot, root, digest("".join(a + b for a, b in path)), folded, folded == root, *([[{"l": a, "r": b} for a, b in path]] if paths else [])))
                yield pd.DataFrame({c: pd.Series([row[k] for row in out], dtype=object) for k, c in enumerate(schema.names)})

    schema = row_type(doc_id="string", leaf="string", subroot="string", root="string", proof_sha256="string", folded_root="string", verified="boolean", **({"path": _PATH} if paths else {}))
    with small_batches(spark, BLOCKS):
        root, ways = _ways(_reduced(blocks, height, scratch, "nodes"), height, bound, scratch)
        out = _met(blocks, ways).mapInPandas(finish, schema)
        out = scratch.keep(out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "manifest")
    scratch.close("manifest")
    return out


def lowered_where_fifth(docs: DataFrame) -> Column:
    """The contract's tampering: texts in lower case (A-Z) where 5 divides the checksum of the decimal doc_id."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % 5) == 0
    return F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
