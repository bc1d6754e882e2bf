"""Benchmark decontamination with a distributed positional inverted index.

The index is a table in the shared folder. Each of its rows is a segment of some
documents (about ``SEGMENT`` characters, a longer text alone): the segment's
distinct terms, for each term the number and the positions of its tokens, and
the documents' ids and lengths. All tokens of all documents are in it, the texts
are read once for it, and segments are searched where they lie, in any order.

A benchmark window (``window`` consecutive item words, or the whole of a shorter
item) is looked up in a segment by its terms' posting lists. The rarest term's
positions, less its offset in the window, are the possible starts; they are
intersected with the other terms' lists, each shifted by its offset, from the
rarest to the commonest. What is left are exact phrase matches. All windows of a
block go through an intersection step together. Windows with two neighbouring
words that are nowhere neighbours in the segment are put aside before, so the
cost of a segment hardly grows with the number of windows. Proximity matches ask
that all terms of the window stand within ``window + slop`` words, in any order;
they are searched by the same lists, and their cost grows with the windows.

The benchmark is streamed in blocks of ``block_bytes`` of text. Each block is
broadcast, searched in one pass over the index and released again, so neither
what is broadcast nor what is held grows with the benchmark.

Terms stand in the index as 64-bit hashes of their bytes.

Defined results: null text has no words and no hits; an item without words has
no windows; an item without item_id makes hits, but is not counted or listed as
an item; rows that repeat are answered one by one; an empty documents or
benchmark table gives no rows, or rows without hits; other columns, of whatever
name, stay as they are.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, fresh, list_of, may_be_among, row_type, slices, small_batches
from .hashing import ODD, mix, word_hashes

#: The bytes that separate words (ASCII without letters and digits) become spaces, A-Z become a-z.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_SPACE = np.arange(256) == 0x20
#: Characters of a segment, and those that are hashed at once; candidates that one intersection step holds.
SEGMENT, SLICE, STEP = 1 << 20, 1 << 18, 1 << 20


def term_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(term of every word, first word of each text and the end). Words: maximal runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    words, bounds, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for some in slices(texts, SLICE):
        w, b = word_hashes([(t or "").encode("utf-8", "surrogatepass").translate(_FOLD) for t in some], _SPACE)
        words.append(w)
        bounds.append(b[1:] + n)
        n += len(w)
    return np.concatenate(words), np.concatenate(bounds)


class Segment:
    """Posting lists of some documents. Positions run through all of them, with one empty place behind each, which no phrase crosses."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, lengths: np.ndarray):
        self.terms, self.counts, self.positions, self.lengths = terms, counts, positions.astype(np.int64), lengths.astype(np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + 1)))[:-1]
        self.size = int((self.lengths + 1).sum())
        # one ascending list for all terms: the list of term t, shifted by t times the segment's size
        self.keys = np.repeat(np.arange(len(terms)) * self.size, counts) + self.positions

    @staticmethod
    def of(texts: list[str | None]) -> Segment:
        words, bounds = term_hashes(texts)
        lengths = np.diff(bounds)
        at = np.arange(len(words)) + np.repeat(np.arange(len(texts)), lengths)
        order = np.argsort(words, kind="stable")
        terms, counts = np.unique(words[order], return_counts=True)
        return Segment(terms, counts.astype(np.int32), at[order].astype(np.int32), lengths.astype(np.int32))

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        """lengths, terms, counts and positions as they are stored: positions as steps in their list, the first from 0, and all numbers by planes of their bytes, as those of the high ones say little."""
        steps = np.diff(self.positions, prepend=0)
        first = self.bounds[:-1][self.counts > 0]
        steps[first] = self.positions[first]
        return self.lengths.astype(np.int32).tobytes(), _planes(self.terms, "<u8"), _planes(self.counts), _planes(steps)

    @staticmethod
    def unpacked(lengths: bytes, terms: bytes, counts: bytes, positions: bytes) -> Segment:
        counts, steps = _whole(counts).astype(np.int64), _whole(positions).astype(np.int64)
        upto = np.cumsum(steps)
        first = np.cumsum(counts) - counts
        before = np.where(first > 0, upto[first - 1], 0) if len(counts) else upto
        return Segment(_whole(terms, "<u8"), counts, upto - np.repeat(before, counts), np.frombuffer(lengths, np.int32))

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The places of terms in the dictionary, -1 where they have none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the list of term has position: one step of an intersection."""
        key = term * self.size + position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (position >= 0) & (position < self.size)

    def holds_between(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the list of term has a position from low to high."""
        base = term * self.size
        at = np.searchsorted(self.keys, base + np.maximum(low, 0))
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= base + np.minimum(high, self.size - 1))

    def pairs(self) -> np.ndarray:
        """Sorted short hashes of the pairs of terms that are neighbours."""
        term = np.full(self.size, -1)
        term[self.positions] = np.repeat(np.arange(len(self.terms)), self.counts)
        some = (term[:-1] >= 0) & (term[1:] >= 0)
        return np.unique(_pair_hash(self.terms[term[:-1][some]], self.terms[term[1:][some]]))

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def _planes(values: np.ndarray, kind: str = "<u4") -> bytes:
    return values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def _whole(planes: bytes, kind: str = "<u4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix(a * np.uint64(ODD) + b) >> np.uint64(32)).astype(np.uint32)


class QueryBlock:
    """Windows of some benchmark items: all terms in a row, and each window's first word, length and item."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.items, self.window = [i for i, _ in items], window
        self.terms, bounds = term_hashes([t for _, t in items])
        n = np.diff(bounds)
        each = np.where(n > 0, np.maximum(1, n - window + 1), 0)
        self.item = np.repeat(np.arange(len(items)), each)
        self.first = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(bounds[:-1], each)
        self.length = np.minimum(n, window)[self.item]
        self.pair = _pair_hash(self.terms[:-1], self.terms[1:]) if len(self.terms) > 1 else np.zeros(0, np.uint32)

    def _all(self, ok: np.ndarray, span: np.ndarray) -> np.ndarray:
        """For each window whether ok holds from its first word on for span words."""
        bad = np.concatenate(([0], np.cumsum(~ok)))
        return bad[self.first + span] == bad[self.first]

    def present(self, number: np.ndarray) -> np.ndarray:
        """Windows all of whose terms stand in a segment."""
        return self._all(number >= 0, self.length)

    def neighbours(self, pairs: np.ndarray) -> np.ndarray:
        """Windows whose neighbouring words are neighbours somewhere in a segment."""
        if not len(pairs):
            return self.length < 2
        at = np.minimum(np.searchsorted(pairs, self.pair), len(pairs) - 1)
        return self._all(pairs[at] == self.pair, self.length - 1)


def _runs(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of rows whose sizes add up to STEP at most, or single rows."""
    upto, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + STEP, side="right")))
        yield slice(i, j)
        i = j


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) for runs of indices: sizes[r] of them from starts[r] on."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[row]


def phrases(seg: Segment, block: QueryBlock, number: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all exact occurrences."""
    found = [np.zeros((2, 0), dtype=np.int64)]
    for length in np.unique(block.length[windows]).tolist():
        some = windows[block.length[windows] == length]
        term = number[block.first[some][:, None] + np.arange(length)]
        order = np.argsort(seg.counts[term], axis=1, kind="stable")
        rows = np.arange(len(some))
        rare = term[rows, order[:, 0]]
        for run in _runs(seg.counts[rare]):
            w, at = _expanded(seg.bounds[rare[run]], seg.counts[rare[run]])
            w = w + run.start
            start = seg.positions[at] - order[w, 0]
            for k in range(1, length):
                ok = seg.holds(term[w, order[w, k]], start + order[w, k])
                w, start = w[ok], start[ok]
            ok = start >= 0
            found.append(np.stack([some[w[ok]], start[ok]]))
    w, start = np.concatenate(found, axis=1)
    return w, start


def nearby(seg: Segment, block: QueryBlock, number: np.ndarray, windows: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, position of its rarest term) where all terms of the window stand within its length + slop words of one document, in any order."""
    found = [np.zeros((2, 0), dtype=np.int64)]
    for length in np.unique(block.length[windows]).tolist():
        some, reach = windows[block.length[windows] == length], length + slop - 1
        term = number[block.first[some][:, None] + np.arange(length)]
        order = np.argsort(seg.counts[term], axis=1, kind="stable")
        term = np.take_along_axis(term, order, axis=1)
        # windows that overlap share their two rarest terms, which are met once for all of them
        rare, which = np.unique(term[:, :2], axis=0, return_inverse=True)
        sizes = seg.counts[rare[:, 0]]
        for run in _runs(sizes):
            pair, at = _expanded(seg.bounds[rare[run, 0]], sizes[run])
            pair, at = pair + run.start, seg.positions[at]
            ok = seg.holds_between(rare[pair, -1], at - reach, at + reach)
            pair, at = pair[ok], at[ok]
            own = np.flatnonzero((which >= run.start) & (which < run.stop))
            n = np.bincount(pair, minlength=len(rare))
            first = np.cumsum(n) - n
            for part in _runs(n[which[own]]):
                w, i = _expanded(first[which[own[part]]], n[which[own[part]]])
                w, p = own[part][w], at[i]
                for k in range(2, length):
                    ok = seg.holds_between(term[w, k], p - reach, p + reach)
                    w, p = w[ok], p[ok]
                ok = np.array([_spanned(seg, np.unique(term[x]), y, reach) for x, y in zip(w.tolist(), p.tolist(), strict=True)], dtype=bool)
                found.append(np.stack([some[w[ok]], p[ok]]))
    w, at = np.concatenate(found, axis=1)
    return w, at


def _spanned(seg: Segment, terms: np.ndarray, at: int, reach: int) -> bool:
    """Whether all terms stand within reach + 1 words of at's document, at or around at."""
    d = int(seg.document(np.array([at]))[0])
    lo, hi = max(int(seg.starts[d]), at - reach), min(int(seg.starts[d] + seg.lengths[d]) - 1, at + reach)
    places = []
    for t in terms.tolist():
        own = seg.keys[seg.bounds[t] : seg.bounds[t + 1]] - t * seg.size
        places += [(int(p), t) for p in own[np.searchsorted(own, lo) : np.searchsorted(own, hi, side="right")]]
    last: dict[int, int] = {}
    for p, t in sorted(places):
        last[t] = p
        if len(last) == len(terms) and p - min(last.values()) <= reach:
            return True
    return False


def search(seg: Segment, block: QueryBlock, slop: int | None = None) -> Iterator[tuple[int, str, int, int, str | None]]:
    """(document, kind, word, length, item) of all matches; kind is 'phrase' or 'near'. A proximity match is told once for a window and document, and only where no phrase match is."""
    if not len(seg.terms) or not len(block.first):
        return
    number = seg.numbers(block.terms)
    here = block.present(number)
    windows, starts = phrases(seg, block, number, np.flatnonzero(here & block.neighbours(seg.pairs())))
    docs = seg.document(starts)
    for w, d, s in zip(windows.tolist(), docs.tolist(), (starts - seg.starts[docs]).tolist(), strict=True):
        yield d, "phrase", s, int(block.length[w]), block.items[block.item[w]]
    if slop is None:
        return
    done = set(zip(windows.tolist(), docs.tolist(), strict=True))
    windows, at = nearby(seg, block, number, np.flatnonzero(here), slop)
    docs = seg.document(at)
    for w, d, s in zip(windows.tolist(), docs.tolist(), (at - seg.starts[docs]).tolist(), strict=True):
        if (w, d) not in done:
            done.add((w, d))
            yield d, "near", s, int(block.length[w]), block.items[block.item[w]]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark, streamed through the driver in blocks of bounded size; an item of more than that stands alone."""
    rows, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        rows.append((r[0], r[1]))
        held += len(r[1] or "") + 16
        if held >= block_bytes:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


class Index:
    """The stored index of a table of documents, by a key column of any type."""

    def __init__(self, docs: DataFrame, key: str, scratch: Scratch, text: str = "text"):
        """key: of a type that survives a cast to string and back. Reads the texts once. The table has a row a segment: segment, keys, lengths, terms, counts, positions."""
        self.scratch, self.kind = scratch, docs.schema[key].dataType
        parts = row_type(segment="long", keys=list_of("string"), lengths="binary", terms="binary", counts="binary", positions="binary")

        def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number = TaskContext.get().partitionId() << 32
            for p in batches:
                keys, at = p["key"].tolist(), 0
                for texts in slices(p["text"], SEGMENT):
                    s = Segment.of(texts)
                    yield pd.DataFrame([(number, keys[at : at + len(texts)], *s.packed())], columns=parts.names)
                    number, at = number + 1, at + len(texts)

        with small_batches(docs.sparkSession, 1000):  # small row groups, as a segment is read whole
            self.table = scratch.keep(docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(build, parts), "index", compression="zstd", **{"parquet.block.size": 16 << 20})

    def documents(self) -> DataFrame:
        """(segment, d, key, n_words) of all documents."""

        @F.pandas_udf(list_of("long"))
        def unpacked(s: pd.Series) -> pd.Series:
            return pd.Series([np.frombuffer(x, np.int32).astype(np.int64) for x in s], dtype=object)

        both = F.arrays_zip(F.col("keys").alias("key"), unpacked("lengths").alias("n_words"))
        return self.table.select("segment", F.posexplode(both).alias("d", "x")).select("segment", "d", F.col("x.key").cast(self.kind).alias("key"), "x.n_words")

    def matches(self, benchmark: DataFrame, window: int = 10, slop: int | None = None, block_bytes: int = 8 << 20) -> DataFrame:
        """(segment, d, kind, start, length, item) of all occurrences of all windows, a table."""
        out_type = row_type(segment="long", d="int", kind="string", start="int", length="int", item="string")
        spark, parts = self.table.sparkSession, []
        for rows in _blocks(benchmark, block_bytes):
            shared = spark.sparkContext.broadcast((rows, window))

            def probe(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                block = QueryBlock(*shared.value)
                for p in batches:
                    for number, *stored in zip(*(p[c] for c in ("segment", "lengths", "terms", "counts", "positions")), strict=True):
                        hits, held = search(Segment.unpacked(*stored), block, slop), True
                        while held:
                            held = [(number, *h) for _, h in zip(range(100_000), hits, strict=False)]
                            if held:
                                yield pd.DataFrame(held, columns=out_type.names)

            with small_batches(spark, 4):
                parts.append(self.scratch.keep(self.table.select("segment", "lengths", "terms", "counts", "positions").mapInPandas(probe, out_type), "matches"))
            shared.destroy()
        if not parts:
            return spark.createDataFrame([], out_type)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int | None = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, kind, start, length), a row for every occurrence of a window: kind is phrase or near, start the first word of the phrase or the rarest term's place."""
    scratch = Scratch(docs.sparkSession, "decontam")
    index = Index(docs.select("doc_id", "text"), "doc_id", scratch)
    found = index.matches(benchmark, window, slop, block_bytes)
    out = found.join(index.documents(), ["segment", "d"]).select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "kind", "start", "length")
    out = scratch.keep(out, "result")
    scratch.close("result")
    return out


@F.pandas_udf(row_type(n_hit="long", n_items="long", n_near="long", items_sha256="string"))
def summary(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Distinct words inside phrase matches (start, end), the items that they stem from, and the items met only by proximity."""
    for spans, items, near in batches:
        rows = []
        for s, i, n in zip(spans, items, near, strict=True):
            end = covered = 0
            for a, b in sorted((x["start"], x["end"]) for x in s):
                covered += max(0, b - max(a, end))
                end = max(end, b)
            ids = sorted(i)
            rows.append((covered, len(ids), len(set(n) - set(ids)), hashlib.sha256(",".join(ids).encode()).hexdigest()))
        yield pd.DataFrame(rows, columns=["n_hit", "n_items", "n_near", "items_sha256"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int | None = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """Per document: n_words, n_hit, n_items, n_near (items met only by proximity), items_sha256, contaminated."""
    scratch = Scratch(docs.sparkSession, "decontam")
    index = Index(docs.select("doc_id", "text"), "doc_id", scratch)
    found, phrase = index.matches(benchmark, window, slop, block_bytes), F.col("kind") == "phrase"
    # a group is one document's matches, each of another place or window
    spans = F.collect_set(F.when(phrase, F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    of = found.groupBy("segment", "d").agg(spans.alias("spans"), F.collect_set(F.when(phrase, F.col("item"))).alias("items"), F.collect_set(F.when(~phrase, F.col("item"))).alias("near"))
    of = of.select("segment", "d", summary("spans", "items", "near").alias("s"))
    nothing = hashlib.sha256(b"").hexdigest()
    out = index.documents().join(of, ["segment", "d"], "left")
    value = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(0).cast("long")).alias(c)
    out = out.select(F.col("key").alias("doc_id"), "n_words", value("n_hit"), value("n_items"), value("n_near"), F.coalesce("s.items_sha256", F.lit(nothing)).alias("items_sha256"))
    out = scratch.keep(out.withColumn("contaminated", F.col("n_hit") > 0), "result")
    scratch.close("result")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """docs without the rows that hold a benchmark window; their columns stay as they are.

    What a text holds depends on the text alone, so its SHA-256 brings the index's answer back to its rows; rows that
    no answer can mean, by a filter of fixed size, are not shuffled."""
    scratch = Scratch(docs.sparkSession, "decontam")
    key, maybe = fresh(docs, "text"), fresh(docs, "maybe")
    keyed = docs.withColumn(key, F.sha2("text", 256))
    found = Index(keyed.select(key, "text"), key, scratch)
    hit = found.matches(benchmark, window, None, block_bytes).where("kind = 'phrase'").select("segment", "d").distinct()
    bad = scratch.keep(found.documents().join(hit, ["segment", "d"], "left_semi").select(F.col("key").alias(key)).distinct(), "bad")
    scratch.close("bad")
    marked = may_be_among(keyed, bad, maybe, key)
    rest = marked.where(maybe).join(bad.withColumnRenamed(key, f"{key}_bad"), F.col(key) == F.col(f"{key}_bad"), "left_anti")
    return marked.where(~F.col(maybe)).unionByName(rest).select(*[F.col(f"`{c}`") for c in docs.columns])
