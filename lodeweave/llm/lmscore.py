"""Subword lattice likelihood of documents.

The pieces of an existing vocabulary (its pieces and ranks are read from a file,
never trained) give every segmentation of a word a weight: the product of its
pieces' probabilities. A log-space forward recursion over the lattice of all
segmentations returns the marginal probability of the word, and the words of a
text with one end mark multiply to that of the text, since no piece crosses a
word's start. The piece probabilities start from the vocabulary's ranks and are
re-estimated on the training fold by expected counts (one step of expectation
maximisation): word types and their counts stand for all of the training text.

Words are counted over all documents in partial tables that follow the input.
The lattice is evaluated once for each distinct word. The ``hot`` commonest words
(a fixed number, none of more than 64 bytes) go to every task with their scores;
each document's other words are joined to the word table by a shuffle. Both ways are exact.

Besides, the smoothed unigram score of whole words is given as a base.

Null text is empty: one end mark and nothing else. Without training rows counts
are zero, and pieces keep the probabilities that their ranks give. Very long texts
and words are read whole; a word without spaces of any length takes memory in
proportion to its bytes. Rows that repeat, in doc_id or in all, are scored one by
one; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from math import exp, log
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import durable, fold, list_of, row_type

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HOT = 100_000
#: Bytes up to which a word can be one of the hot ones, so that what is broadcast is bounded in bytes too.
HOT_BYTES = 64
#: Bytes of a word from which on its lattice is not held whole.
LONG = 2048
#: The mark of a word's start: no word holds a space.
_START = b" "


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and \\t..\\r, A-Z in lower case: what bytes.split and bytes.lower mean by white space and letters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Lattice:
    """Pieces as bytes with natural logarithms of their probabilities."""

    def __init__(self, logp: dict[bytes, float], end: float):
        self.logp, self.end = logp, end
        # beginnings of pieces too, so that a search along a word ends where no piece goes on
        self.ahead: dict[bytes, float | None] = {p[:k]: None for p in logp for k in range(1, len(p))}
        self.ahead.update(logp)

    @staticmethod
    def read(path: str) -> Lattice:
        """Probabilities after Zipf's law of the vocabulary's ranks; each of the 256 bytes is a piece too."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        weight: dict[bytes, float] = {bytes([b]): 1e-6 for b in range(256)}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            piece = model.id_to_piece(i).replace("\N{LOWER ONE EIGHTH BLOCK}", " ").encode()
            if b" " in piece[1:]:  # no word has a second mark
                continue
            weight[piece] = weight.get(piece, 0.0) + 1.0 / (i + 50)
        total = sum(weight.values()) * 1.05
        return Lattice({k: math.log(v / total) for k, v in weight.items()}, math.log(0.05 / 1.05))

    def _far(self, data: bytes, i: int) -> Iterator[tuple[int, float]]:
        """(end, log probability) of the pieces that begin at i."""
        get = self.ahead.get
        for j in range(i + 1, len(data) + 1):
            p = get(data[i:j], _MISSING)
            if p is _MISSING:
                return
            if p is not None:
                yield j, p

    def _alphas(self, data: bytes) -> np.ndarray:
        """The forward recursion for a word of any length: besides the numbers themselves only the arcs of the longest piece's reach are held."""
        n = len(data)
        alpha, pending = np.full(n + 1, -np.inf), {0: [0.0]}
        for i in range(n + 1):
            into = pending.pop(i, None)
            if into is None:
                continue
            best = max(into)
            alpha[i] = a = best + log(sum([exp(v - best) for v in into]))
            for j, p in self._far(data, i):
                pending.setdefault(j, []).append(a + p)
        return alpha

    def _arcs(self, word: bytes) -> tuple[list[float], list[list[tuple[int, float]]]]:
        """alpha and, for each place, the arcs that end there: (start, alpha[start] + log probability of the piece between)."""
        data = _START + word
        get, n = self.ahead.get, len(data)
        alpha = [0.0] * (n + 1)
        arcs: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            into = arcs[i]
            if len(into) == 1:
                alpha[i] = into[0][1]
            elif into:
                best = max(into, key=_second)[1]
                alpha[i] = best + log(sum([exp(v - best) for _, v in into]))
            elif i:
                alpha[i] = -math.inf
                continue
            a = alpha[i]
            for j in range(i + 1, n + 1):
                p = get(data[i:j], _MISSING)
                if p is None:
                    continue
                if p is _MISSING:
                    break
                arcs[j].append((i, a + p))
        into = arcs[n]
        best = max(into, key=_second)[1]
        alpha[n] = best + log(sum([exp(v - best) for _, v in into]))
        return alpha, arcs

    def forward(self, word: bytes) -> list[float]:
        """alpha[j]: log of the summed probability of all segmentations of the first j bytes, the word start mark being the first."""
        return self._arcs(word)[0]

    def log10(self, word: bytes) -> float:
        if len(word) > LONG:
            return float(self._alphas(_START + word)[-1]) / _LN10
        return self._arcs(word)[0][-1] / _LN10

    def expect(self, word: bytes, count: float, into: dict[bytes, float]) -> None:
        """Adds count times the posterior number of uses of each piece in the word."""
        data = _START + word
        if len(word) > LONG:
            self._expect_long(data, count, into)
            return
        alpha, arcs = self._arcs(word)
        mass = [0.0] * len(data) + [count]  # of segmentations that pass through a place
        for j in range(len(data), 0, -1):
            m = mass[j]
            if m <= 0.0:
                continue
            end = alpha[j]
            for i, v in arcs[j]:
                share = m * exp(v - end)
                mass[i] += share
                piece = data[i:j]
                into[piece] = into.get(piece, 0.0) + share

    def _expect_long(self, data: bytes, count: float, into: dict[bytes, float]) -> None:
        """expect by a backward recursion, which needs no arcs: a piece's share is that of the segmentations through both its ends."""
        alpha, n = self._alphas(data), len(data)
        beta = np.full(n + 1, -np.inf)
        beta[n] = 0.0
        for i in range(n - 1, -1, -1):
            on = [(j, p + beta[j]) for j, p in self._far(data, i)]
            best = max((v for _, v in on), default=-math.inf)
            if best == -math.inf:
                continue
            beta[i] = best + log(sum([exp(v - best) for _, v in on]))
            if alpha[i] == -math.inf:
                continue
            for j, v in on:
                share = count * exp(alpha[i] + v - alpha[n])
                if share > 0.0:
                    piece = data[i:j]
                    into[piece] = into.get(piece, 0.0) + share

    def updated(self, expected: dict[bytes, float], ends: float, prior: float = 1000.0) -> Lattice:
        """Probabilities from expected counts, the old ones counting as ``prior`` uses."""
        total = sum(expected.values()) + ends + prior
        return Lattice({k: math.log((expected.get(k, 0.0) + prior * math.exp(v)) / total) for k, v in self.logp.items()}, math.log((ends + prior * math.exp(self.end)) / total))


_LN10 = math.log(10)
_MISSING = object()
_second = itemgetter(1)


def _texts(docs: DataFrame, train: Column) -> DataFrame:
    return docs.select(F.col("text"), train.alias("train"))


def word_table(docs: DataFrame, train: Column, flush: int = 400_000) -> DataFrame:
    """word, c (uses in training rows), n (uses in all rows); a task holds at most about ``flush`` distinct words at a time."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, rest = Counter(), Counter()

        def out():
            keys = list(own.keys() | rest.keys())
            return pd.DataFrame({"word": keys, "c": [own[k] for k in keys], "n": [own[k] + rest[k] for k in keys]})

        for p in batches:
            for t, is_train in zip(p["text"], p["train"], strict=True):
                (own if is_train else rest).update(words(t))
                if len(own) + len(rest) > flush:
                    yield out()
                    own.clear()
                    rest.clear()
        yield out()

    parts = _texts(docs, train).mapInPandas(count, row_type(word="binary", c="long", n="long"))
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def train_lattice(table: DataFrame, lattice: Lattice, ends: int, steps: int = 1) -> Lattice:
    """Expectation maximisation over word types; each step brings one number per piece to the driver."""
    for _ in range(steps):
        shared = table.sparkSession.sparkContext.broadcast(lattice)

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            into: dict[bytes, float] = {}
            for p in batches:
                for w, c in zip(p["word"], p["c"], strict=True):
                    shared.value.expect(bytes(w), float(c), into)
            yield pd.DataFrame({"piece": list(into), "uses": list(into.values())})

        found = table.where("c > 0").select("word", "c").mapInPandas(expect, row_type(piece="binary", uses="double"))
        found = found.groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        lattice = lattice.updated({bytes(r["piece"]): r["uses"] for r in found}, float(ends))
    return lattice


def scored_words(table: DataFrame, lattice: Lattice) -> DataFrame:
    """The word table with lp, the log10 marginal probability of each word."""
    shared = table.sparkSession.sparkContext.broadcast(lattice)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(lp=[shared.value.log10(bytes(w)) for w in p["word"]])

    return table.mapInPandas(score, row_type(word="binary", c="long", n="long", lp="double"))


_PARTIAL = row_type(n_tokens="long", n_known="long", base="double", lp="double", rare=list_of(row_type(word="binary", k="int")))


def score_documents(docs: DataFrame, train: Column, vocabulary: str = VOCABULARY, steps: int = 1, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text) with held_out, n_tokens, n_known, train_tokens, base_score and score."""
    sc = docs.sparkSession.sparkContext
    counts = durable(word_table(docs, train), "lm-words")
    total, kinds = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = docs.where(train).count()
    total, kinds = total + ends, kinds + (1 if ends else 0)
    lattice = train_lattice(counts, Lattice.read(vocabulary), ends, steps)
    table = durable(scored_words(counts, lattice), "lm-scores")
    scale = total + (kinds + 1)
    common = {bytes(r["word"]): (r["c"], math.log10((r["c"] + 1) / scale), r["lp"]) for r in table.where(F.octet_length("word") <= HOT_BYTES).orderBy(F.col("n").desc(), "word").limit(hot).toPandas().to_dict("records")}
    shared = sc.broadcast((common, ends, scale, lattice.end / _LN10))

    @F.pandas_udf(_PARTIAL)
    def partial(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common, ends, scale, end = shared.value
        get, end_base = common.get, math.log10((ends + 1) / scale)
        for s in batches:
            rows = []
            for t in s:
                n, known, base, lp, rare = 1, int(ends > 0), end_base, end, []
                for w, k in Counter(words(t)).items():
                    n += k
                    found = get(w)
                    if found is None:
                        rare.append({"word": w, "k": k})
                        continue
                    known += k if found[0] else 0
                    base += k * found[1]
                    lp += k * found[2]
                rows.append((n, known, base, lp, rare))
            yield pd.DataFrame(rows, columns=_PARTIAL.names)

    made = docs.select("doc_id", (~train).alias("held_out"), partial(F.col("text")).alias("p"))
    made = durable(made.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "p.*"), "lm-partial")
    rare = made.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k").join(table.select("word", "c", "lp"), "word")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known_"), F.sum(F.col("k") * F.log10((F.col("c") + 1) / F.lit(float(scale)))).alias("base_"), F.sum(F.col("k") * F.col("lp")).alias("lp_"))
    out = made.drop("rare").join(rare, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known_")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + zero("base_")).alias("base_score"), (F.col("lp") + zero("lp_")).alias("score"))


def scored(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Scores of all documents, learned from those outside fold 2 of 7."""
    return score_documents(docs.select("doc_id", "text"), fold(F.col("doc_id"), 7) != 2, vocabulary)
