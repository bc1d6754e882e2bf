"""N-gram Jaccard join by parity sketches, with connected components.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. Two sets
A and B of Jaccard similarity 3/4 or more differ in at most (|A| + |B|) / 7
shingles. A parity sketch flips one bit for each shingle, so the Hamming distance
of two sketches is at most that difference.

Candidates. Sizes are cut into bands. The sketch of a band's scheme has P parts of
2^20 bits; two similar sets differ in at most D bits, and P exceeds D, so at least
one part is equal in both (pigeonhole). Sets are joined on (scheme, part, bits of
the part). Parts without bits are not emitted: a set with more than D parts that
have bits must share such a part with any similar set. The few sets with fewer
emit every shingle as well, and two such sets share a shingle. A set takes part in
its own band's scheme and, if a smaller partner can stand there, in that of the
band below. No candidate is lost, for any texts.

Verification. Exact copies are one class from the start. Inside a group of equal
parts not all pairs are formed: first all are compared with the group's smallest
document, then, where a group still falls into several components, with some
further members, and last all pairs across components that have not been compared
yet and whose sketches are near enough. Links inside a component need no proof,
so components are exact. Every comparison counts shared shingles of whole texts.

Rows that share a doc_id are one document with the links of all its texts; a null
doc_id links with nothing. Null and empty texts have no shingles and link with
nothing. Very long texts are hashed alone. An empty table gives no rows; other
columns are not read.

All steps write tables (Scratch); they are deleted as soon as nothing reads them,
and all but the result at the end.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, fresh, may_be_among, row_type, slices, small_batches
from .hashing import MASK, ODD, mix, word_hashes

N_WORDS = 5
SKETCH_LONGS = 32
#: Characters of text that are hashed at once.
SLICE = 1 << 18
#: Entries of the signature join that one task of it holds, about.
BUCKET = 1_500_000
#: Rounds in which further members of unsettled groups are compared with all others, and how many of them each.
HUB_TURNS, HUBS = 2, 12

# --- hashing -----------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingles(texts: list[str | None], n: int = N_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than n words, the whole sequence is one."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    word, bounds = word_hashes(parts, _SPACE)
    rolled = np.zeros(max(0, len(word) - n + 1), dtype=np.uint64)
    for k in range(n):
        rolled = rolled * np.uint64(ODD) + word[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            h = b - a
            for w in word[a:b].tolist():
                h = (h * ODD + w) & MASK
            out.append(mix(np.array([h], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


# --- sketches ----------------------------------------------------------------

_BANDS = [1]
while _BANDS[-1] < 1 << 40:
    _BANDS.append(max(_BANDS[-1] + 1, int(_BANDS[-1] * 1.45)))
_BANDS = np.array(_BANDS)


#: Share and number of parts beyond the largest difference, by level; a later level is for sets that leave too many parts of the one before empty.
LEVELS = ((0.15, 1), (0.6, 4))


def parts_of(band: int, level: int = 0) -> int:
    """Parts of the sketch of a band's scheme: more than the largest difference, and some to make up for empty ones."""
    d = (int(_BANDS[band + 1]) - 1) // 3
    share, more = LEVELS[level]
    return 1 if d == 0 else d + 1 + -int(-(d + 1) * share // 1) + more


def signatures(s: np.ndarray) -> np.ndarray:
    """Join keys of a set: any similar set has one of them too.

    Of two sets either one has more parts with bits, at some level that both emit, than they can differ in, or both emit every shingle."""
    n, out = len(s), []
    if not n:
        return s
    band = int(np.searchsorted(_BANDS, n, side="right")) - 1
    for level in range(len(LEVELS)):
        sparse = False
        for b in (band, band - 1):
            if b < 0:
                continue
            upper = int(_BANDS[b + 1]) - 1  # the largest size of the smaller set in this scheme
            if b < band and 3 * n > 4 * upper:
                continue
            differ = n // 3 if b == band else (n + upper) // 7
            p = parts_of(b, level)
            part = (s >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)
            bit = part << np.uint64(20) | s & np.uint64(0xFFFFF)
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))  # s is sorted, and so are parts
            bits = np.bitwise_xor.reduceat(mix(bit), at)  # flipping a bit twice cancels
            some = bits != 0
            key = mix(bits ^ mix(part[at] << np.uint64(8) | np.uint64(2 * b + level)))[some]
            out.append(key)
            sparse |= len(key) <= differ
        if not sparse:
            return np.concatenate(out)
    return np.concatenate([*out, mix(s ^ np.uint64(0x5851F42D4C957F2D))])


def sketch(s: np.ndarray) -> bytes:
    """Parity sketch of four to eight bits a member, a power of two and 64 * SKETCH_LONGS at least; one of half the length is its halves' exclusive or."""
    longs = SKETCH_LONGS
    while longs * 16 < len(s):
        longs *= 2
    bits = np.bincount((s & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(data: bytes, longs: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(data, np.uint64).reshape(-1, longs), axis=0)


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches at the length of the shorter: at most the number of shingles in which the sets differ."""
    longs = min(len(a), len(b)) // 8
    return int(np.bitwise_count(folded(a, longs) ^ folded(b, longs)).sum())


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, whatever the order of their members."""
    a, b = int(np.add.reduce(mix(s))), int(np.bitwise_xor.reduce(mix(s ^ np.uint64(ODD)))) if len(s) else 0
    return a - (1 << 63), b - (1 << 63)


# --- candidates --------------------------------------------------------------


#: Kinds of packed rows: join entries without and with companions in their flush, and the companions themselves.
ALONE, JOINED, LOCAL = 0, 1, 2


def _packed(keys: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, entries, blob) of join entries; a blob is 4 bytes of key an entry, then ids as differences."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    low, ids = keys.astype(np.uint32)[order], ids[order]
    for b in range(buckets):
        x, y = bounds[b], bounds[b + 1]
        if x < y:
            own = ids[x:y]
            step = np.diff(own)
            kind = np.uint16 if len(step) == 0 or 0 <= step.min() and step.max() < 1 << 16 else np.int64
            yield b, y - x, bytes([kind is np.int64]) + int(own[0]).to_bytes(8, "little", signed=True) + low[x:y].tobytes() + step.astype(kind).tobytes()


def _unpacked(n: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    first = int.from_bytes(blob[1:9], "little", signed=True)
    step = np.frombuffer(blob, np.int64 if blob[0] else np.uint16, n - 1, 9 + 4 * n).astype(np.int64)
    return np.frombuffer(blob, np.uint32, n, 9), np.cumsum(np.concatenate(([first], step)))


def _emit(buckets: int, flush: int = 600_000):
    """Texts to packed join entries. Of the documents of one flush that share a key only the smallest
    enters the join; the others are told with it at once (LOCAL), so that a hot key sends one entry a flush."""

    def out(held: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
        held.sort(key=lambda x: x[0])
        keys = np.concatenate([k for _, k in held])
        ids = np.repeat(np.array([d for d, _ in held], dtype=np.int64), [len(k) for _, k in held])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        first = np.concatenate(([True], k[1:] != k[:-1]))
        shared = np.zeros(len(k), dtype=bool)
        shared[1:] |= ~first[1:]
        shared[:-1] |= ~first[1:]
        rows = []
        for kind, some in ((ALONE, first & ~shared), (JOINED, first & shared)):
            sent = np.sort(order[some])
            rows += [(b, kind, n, blob) for b, n, blob in _packed(keys[sent], ids[sent], buckets)] if len(sent) else []
        told = order[shared]
        for i in range(0, len(told), 200_000):
            some = told[i : i + 200_000]
            b = ((keys[some] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            group = (b << 32 | (keys[some] & np.uint64(0xFFFFFFFF)).astype(np.int64)).tobytes()
            rows.append((int(mix(np.array([held[0][0] + i], dtype=np.int64).view(np.uint64))[0] % np.uint64(buckets)), LOCAL, len(some), group + ids[some].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "kind", "n", "blob"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, np.ndarray]] = []
        seen: dict[tuple[int, int, int], int] = {}
        size = 0
        for p in batches:
            ids, at = p["doc_id"].tolist(), 0
            for texts in slices(p["text"], SLICE):
                for s in shingles(texts):
                    d = ids[at]
                    at += 1
                    if not len(s):
                        continue
                    same = (len(s), *digest(s))
                    if same in seen:  # an exact copy; classes of copies are known already
                        continue
                    seen[same] = d
                    held.append((d, signatures(s)))
                    size += len(held[-1][1])
                    if size > flush:
                        yield out(held)
                        held, size = [], 0
                        seen.clear()
        if held:
            yield out(held)

    return run


def _stars(groups: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Rows (smallest member, member) of each group; groups ascend."""
    first = np.concatenate(([True], groups[1:] != groups[:-1]))
    at = np.cumsum(first) - 1
    low = np.minimum.reduceat(docs, np.flatnonzero(first))[at]
    return np.unique(np.column_stack([low, docs])[low != docs], axis=0)


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entries of a bucket to pairs (smallest member, member) of keys that several have (pair true, x, y), and to
    members (pair false, group, document) of those groups in which further pairs may have to be compared."""
    b = int(pdf["bucket"].iloc[0])
    keys, ids, joined, pairs, members = [], [], [], [], []
    for kind, n, blob in zip(pdf["kind"], pdf["n"], pdf["blob"], strict=True):
        if kind == LOCAL:
            g, d = np.frombuffer(blob, np.int64, n), np.frombuffer(blob, np.int64, n, 8 * n)
            order = np.argsort(g, kind="stable")
            pairs.append(_stars(g[order], d[order]))
            members.append(np.column_stack([g, d]))
        else:
            k, i = _unpacked(n, blob)
            keys.append(k)
            ids.append(i)
            joined.append(np.full(n, kind == JOINED))
    if keys:
        k, i, j = np.concatenate(keys), np.concatenate(ids), np.concatenate(joined)
        order = np.argsort(k, kind="stable")
        k, i, j = k[order], i[order], j[order]
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(at, len(k)))
        more = np.add.reduceat(j.astype(np.int64), at)
        each = np.repeat(size, size)
        if (each > 1).any():
            pairs.append(_stars(k[each > 1].astype(np.int64), i[each > 1]))
        # the one pair of a group of two without companions is compared already
        open_ = np.repeat((size > 2) | (size == 2) & (more > 0), size)
        members.append(np.column_stack([(np.int64(b) << 32) | k[open_].astype(np.int64), i[open_]]))
    none = np.zeros((0, 2), np.int64)
    p, m = np.unique(np.concatenate([none, *pairs]), axis=0), np.concatenate([none, *members])
    out = np.concatenate([p, m])
    return pd.DataFrame({"pair": np.arange(len(out)) < len(p), "x": out[:, 0], "y": out[:, 1]})


def candidates(docs: DataFrame, entries: int) -> DataFrame:
    """(pair, x, y): documents that share a part of a sketch; see _meet."""
    buckets = max(48, -(-entries // BUCKET))
    packed = docs.mapInPandas(_emit(buckets), row_type(bucket="int", kind="int", n="int", blob="binary"))
    return packed.groupBy("bucket").applyInPandas(_meet, row_type(pair="boolean", x="long", y="long"))


# --- verification ------------------------------------------------------------

#: Longs of the folded sketches by which the pairs inside groups are sifted.
FOLDED = 8

_SET = row_type(n_shingles="long", d1="long", d2="long", bits="binary", short="binary", sketch="binary")


@F.pandas_udf(_SET)
def set_summary(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Size, digest and sketch of the shingle set of each text: folded to FOLDED and to SKETCH_LONGS longs, and whole where that is longer."""
    for s in batches:
        rows = []
        for texts in slices(s, SLICE):
            for x in shingles(texts):
                whole = sketch(x)
                rows.append((len(x), *digest(x), folded(whole, FOLDED).tobytes(), folded(whole, SKETCH_LONGS).tobytes(), whole if len(whole) > 8 * SKETCH_LONGS else None))
        yield pd.DataFrame(rows, columns=_SET.names)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * |A and B| >= 75 * |A or B|, for non-empty sets."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


@F.pandas_udf(T.BooleanType())
def _linked(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    last, of_last = None, None
    for a_id, a_text, b_text in batches:
        out, at = [], 0
        for texts in slices(b_text, SLICE):
            for s in shingles(texts):
                key = (a_id.iat[at], a_text.iat[at])
                if key != last:
                    last, of_last = key, shingles([a_text.iat[at]])[0]
                out.append(similar(of_last, s))
                at += 1
        yield pd.Series(out, dtype=bool)


@F.pandas_udf(T.BooleanType())
def _near(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether sizes and sketches allow a link: no similar pair fails."""
    for n, x, m, y in batches:
        yield pd.Series([min(a, b) * 4 >= max(a, b) * 3 and distance(p, q) * 7 <= a + b for a, p, b, q in zip(n, x, m, y, strict=True)], dtype=bool)


def _possible(pairs: DataFrame, light: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow; light: doc_id, n, short, sketch. All are sifted by short sketches first, so that long ones travel with few pairs."""
    side = lambda of, name, *more: of.select(F.col("doc_id").alias(name), "n", *more).alias(name)
    short = light.select("doc_id", "n", "short", F.col("sketch").isNotNull().alias("long"))
    near = pairs.join(side(short, "a", "short", "long"), "a").join(side(short, "b", "short", "long"), "b")
    near = scratch.keep(near.where(_near("a.n", "a.short", "b.n", "b.short")).select("a", "b", (F.col("a.long") & F.col("b.long")).alias("both")), "near", replace=True)
    if near.where("both").isEmpty():
        return near.select("a", "b")
    whole = light.where(F.col("sketch").isNotNull())
    rest = near.where("both").join(side(whole, "a", "sketch"), "a").join(side(whole, "b", "sketch"), "b").where(_near("a.n", "a.sketch", "b.n", "b.sketch"))
    return scratch.keep(near.where("not both").select("a", "b").unionByName(rest.select("a", "b")), "near", replace=True)


def _verified(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that link, by their whole texts. The filter spares most other texts the shuffle; the joins are exact."""
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = scratch.keep(may_be_among(docs, ends, "wanted").where("wanted").select("doc_id", "text").join(ends, "doc_id"), "texts", replace=True)
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.where(_linked("a", "text_a", "text_b")).select("a", "b").distinct()


#: Rounds after which components() gives up; each shortens a chain by a constant factor, so it is out of reach.
ROUNDS = 200


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc, comp) for the ends of edges (a, b): comp is the smallest document that can be reached.

    Alternating large and small stars: each round hangs neighbours on smaller
    ones, so a chain shortens by a constant factor; a hot node's edges are
    rewritten by joins, never gathered."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    e = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars", replace=True)
    before = None
    for _ in range(ROUNDS):
        # large star: the larger neighbours of u hang on the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large, "large", replace=True)
        # small star: u and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars", replace=True)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
    parents = e.groupBy("u").agg(F.min("v").alias("comp"))
    roots = e.select(F.col("v").alias("u")).distinct().join(parents, "u", "left_anti").select("u", F.col("u").alias("comp"))
    out = scratch.keep(parents.unionByName(roots).select(F.col("u").alias("doc"), "comp"), "found", replace=True)
    scratch.drop("stars", "large")
    return out


def _merged(comps: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """comps (doc, comp) with further links (a, b): only the links between different components are followed, by the components' names."""
    if comps is not None:
        of = lambda c: comps.select(F.col("doc").alias(c), F.col("comp").alias(f"{c}_comp"))
        links = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    found = components(links, scratch)
    if comps is None:
        return scratch.keep(found, "comps", replace=True)
    x, y = comps.alias("x"), found.alias("y")
    known = x.join(y, F.col("x.comp") == F.col("y.doc"), "left").select("x.doc", F.coalesce("y.comp", "x.comp").alias("comp"))
    # ends of links that were in no component before
    new = found.join(comps, "doc", "left_anti").select("doc", "comp")
    return scratch.keep(known.unionByName(new), "comps", replace=True)


def _across(groups: DataFrame, lookup: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, doc, comp) of groups (grp, doc) that still fall into several components; copies count once. lookup: doc, rep, comp."""
    g = groups.join(lookup, "doc").select("grp", F.col("rep").alias("doc"), "comp")
    split = g.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("grp")
    return scratch.keep(g.join(split, "grp").distinct(), "split", replace=True)


def _pair(x: str, y: str) -> list[F.Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


#: Members of a group that one task compares.
BLOCK = 2048


def _sift(hubs: int, turn: int):
    """(a, b) across components whose sizes and folded sketches allow a link, in the groups of a bucket: all such pairs,
    or those with one of ``hubs`` members of the group, another choice in each turn. Of a block pair (i, j) only pairs between i and j."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc = pdf["doc"].to_numpy()
        chance = mix(doc.view(np.uint64) ^ np.uint64(turn + 1)) if hubs else np.arange(len(doc), dtype=np.uint64)
        order = np.lexsort((chance, pdf["j"].to_numpy(), pdf["i"].to_numpy(), pdf["grp"].to_numpy()))
        pdf = pdf.iloc[order]
        keys = pdf[["grp", "i", "j"]].to_numpy()
        doc, comp, n, side = (pdf[c].to_numpy() for c in ("doc", "comp", "n", "side"))
        bits = np.frombuffer(b"".join(pdf["bits"]), dtype=np.uint64).reshape(len(pdf), FOLDED)
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        sizes = np.diff(np.append(starts, len(pdf)))
        found = [np.zeros((0, 2), np.int64)]

        def compare(x: np.ndarray, y: np.ndarray) -> None:
            ok = (comp[x] != comp[y]) & ((side[x] == 2) | (side[x] != side[y])) & (np.minimum(n[x], n[y]) * 4 >= np.maximum(n[x], n[y]) * 3)
            x, y = x[ok], y[ok]
            near = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) * 7 <= n[x] + n[y]
            x, y = doc[x[near]], doc[y[near]]
            found.append(np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0))

        for k in np.unique(sizes).tolist():
            at, rows = starts[sizes == k], min(hubs or k, k - 1)
            if k <= 64:  # all groups of a size at once
                i, j = np.triu_indices(k, 1)
                i, j = i[i < rows], j[i < rows]
                for some in np.array_split(at, max(1, len(at) * len(i) // 200_000)):
                    compare((some[:, None] + i).ravel(), (some[:, None] + j).ravel())
            else:
                for s in at.tolist():
                    for i in range(rows):
                        compare(np.full(k - 1 - i, s + i), np.arange(s + i + 1, s + k))
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    return run


def _sifted(split: DataFrame, light: DataFrame, hubs: int = 0, turn: int = 0) -> DataFrame:
    """(a, b): pairs of groups across components that sizes and folded sketches allow, all or those of some hubs. A group of more than BLOCK members is compared in pairs of blocks, each a task's share."""
    short = light.select(F.col("doc_id").alias("doc"), "n", "bits")
    blocks = split.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    x = split.join(blocks, "grp").join(short, "doc").withColumn("m", F.pmod(F.xxhash64("doc"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")
    x = x.select("grp", "doc", "comp", "n", "bits", "k", "m", other)
    # side: 0 and 1 for the two blocks of a pair, 2 where a block meets itself
    x = x.select("grp", "doc", "comp", "n", "bits", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"), F.when(F.col("m") == F.col("o"), 2).when(F.col("m") < F.col("o"), 0).otherwise(1).alias("side"))
    spread = F.pmod(F.xxhash64("grp", "i", "j"), F.lit(max(48, split.count() // 200_000)))
    return x.groupBy(spread.alias("bucket")).applyInPandas(_sift(hubs, turn), row_type(a="long", b="long")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles and component_id. doc_id is an integer of any width."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"doc_id has to be an integer, not {kind.simpleString()}")
    scratch = Scratch(docs.sparkSession, "jaccard")
    with small_batches(docs.sparkSession):  # all steps in Python run in here, into tables
        out = scratch.keep(_classes(docs, scratch), "result")
    scratch.close("result")
    return out


def _copies(known: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, rep): the smallest document of each class of exact copies. Both sides are tables, so a hot class is dealt out by adaptive skew joins."""
    known = scratch.keep(known.select("doc_id", "n_shingles", "d1", "d2"), "keys")
    first = scratch.keep(known.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep")), "first")
    out = scratch.keep(known.join(first, ["n_shingles", "d1", "d2"]).select("doc_id", "rep").distinct(), "copies")
    scratch.drop("keys", "first")
    return out


def _classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = scratch.keep(docs.select("doc_id", set_summary("text").alias("s")).select("doc_id", "s.*"), "sets")
    known = sets.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    copies = _copies(known, scratch)
    light = known.select("doc_id", F.col("n_shingles").alias("n"), "bits", "short", "sketch")
    entries = int((known.agg(F.sum("n_shingles")).first()[0] or 0) * 0.7)

    named = docs.where(F.col("doc_id").isNotNull())
    found = scratch.keep(candidates(named, entries), "candidates")
    groups = found.where("not pair").select(F.col("x").alias("grp"), F.col("y").alias("doc"))
    # copies stand for one another; the texts that share a doc_id are one document
    several = copies.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("doc_id")
    same = copies.join(several, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    rep = lambda c: copies.select(F.col("doc_id").alias(c), F.col("rep").alias(f"{c}_rep"))
    tested = found.where("pair").select("x", "y").distinct().join(rep("x"), "x").join(rep("y"), "y").where("x_rep <> y_rep").select(*_pair("x_rep", "y_rep")).distinct()
    tested = scratch.keep(tested, "pairs")
    proved = _verified(_possible(tested, light, scratch), named, scratch)
    comps, split = _merged(None, proved.unionByName(same), scratch), groups
    for turn in range(HUB_TURNS + 1):
        lookup = copies.select(F.col("doc_id").alias("doc"), "rep").join(comps.select(F.col("doc").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        # components only grow, so a group that is settled stays so; from the second turn on members are representatives
        split = _across(split.select("grp", "doc"), lookup, scratch)
        if split.isEmpty():
            break
        # some turns compare further members of each group with all others of it, the last one whatever is left
        more = scratch.keep(_sifted(split, light, HUBS if turn < HUB_TURNS else 0, turn).join(tested, ["a", "b"], "left_anti"), "pairs")
        near, tested = _possible(more, light, scratch), tested.unionByName(more)
        if not near.isEmpty():
            comps = _merged(comps, _verified(near, named, scratch), scratch)
    scratch.drop("candidates", "pairs", "near", "texts", "split")
    comp_of = copies.join(comps.select(F.col("doc").alias("rep"), "comp"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("comp"))
    comp_of = scratch.keep(comp_of, "comp-of")
    return sets.select("doc_id", "n_shingles").join(comp_of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    return _orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with only the smallest doc_id of every component. Rows without doc_id stay.

    Of rows that share a doc_id the smallest by all columns stays (columns without
    an order, such as maps, don't count in that). Only rows whose doc_id repeats
    or goes, and some others that a filter of fixed size takes for such, are
    shuffled; all columns stay as they are."""
    found = classes(docs)
    scratch = Scratch(docs.sparkSession, "keep-one")
    state = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n"))
    state = scratch.keep(state.where("n > 1 or c <> doc_id").select("doc_id", (F.col("c") != F.col("doc_id")).alias("gone")), "state")
    name, row, kept = fresh(docs, "maybe"), fresh(docs, "row"), [F.col(f"`{c}`") for c in docs.columns]
    marked = may_be_among(docs, state, name).withColumn(name, F.col(name) & F.col("doc_id").isNotNull())
    order = F.struct(*[F.col(f"`{f.name}`") for f in docs.schema if _orderable(f.dataType)])
    # one row of a doc_id is taken before the shuffle, so a row that stands in many copies sends one a task
    one = marked.where(name).groupBy(F.col("doc_id").alias(f"{name}_id")).agg(F.min_by(F.struct(*kept), order).alias(row))
    gone = state.where("gone").select(F.col("doc_id").alias(f"{name}_id"))
    return marked.where(~F.col(name)).select(*kept).unionByName(one.join(gone, f"{name}_id", "left_anti").select(f"{row}.*"))
