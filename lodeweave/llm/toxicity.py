"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: case, accents and compatibility forms go, look-alike
letters of other scripts become Latin, digits and signs that stand in for letters
become those letters, and whatever is no letter becomes a single space. Lexicon
entries are whole words and word beginnings; one pass of the automaton finds all
of them, and the automaton also holds exception phrases, inside which an entry
does not count. The weights of what is found are added up, normalised by length,
and turned into a probability.

Lexicon, exceptions and the final weights are learned from at most
``2 * per_class`` labelled documents (``labelled_sample``). A term's weight is
the smoothed logarithm of how much likelier toxic documents hold it than others;
a phrase of an entry with its neighbour that only clean documents hold is an
exception. The lexicon has at most ``max_terms`` entries, so it can be broadcast.

Null and empty texts have no matches and get the lowest score. Without labelled
rows of both classes the lexicon is empty, and every score is the same. Very long
texts are folded and matched whole. Rows that repeat are scored one by one, alike;
an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import durable, fold, labelled_sample, row_type

#: Letters that look like Latin ones, by script.
_LIKE = {
    "абвеёзикмнорстухѕіјһԁԛԝ": "abbeeeukmhopctyxsijhdqw",
    "αβγεζηικμνορτυχωϲ": "abyeznikuvoptuxwc",
    "ɑɡıⅼɩ": "agiii",
}
#: Digits and signs that stand in for letters. 1, i and l are one letter here, on both sides.
_DIGITS = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}

_TABLE = str.maketrans({a: b for k, v in _LIKE.items() for a, b in zip(k, v, strict=True)})
_TABLE |= str.maketrans(_DIGITS)
_MARKS = re.compile("[̀-ͯ​-‏⁠﻿­]+")
_INNER = re.compile(r"(?<=[^\W_])[@$!|€+](?=[^\W_])")
_OTHER = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """' word word ' of the folded text."""
    if not text:
        return " "
    t = text.lower()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
    t = _INNER.sub(lambda m: _SIGNS[m[0]], t)
    return f" {_OTHER.sub(' ', t.translate(_TABLE)).strip()} "


#: Lengths of word beginnings that can be entries.
STEMS = (4, 5, 6)


def terms(words: set[str]) -> set[str]:
    """Candidate entries: ' word ' and, for longer words, ' stem'."""
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    #: Phrases of folded words, ' a b ', inside which entries do not count.
    exceptions: tuple[str, ...] = ()
    #: Of the logistic function of (1, weight sum, sum by root of the length, sum by length).
    final: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        auto = ahocorasick.Automaton()
        for term, w in self.weights.items():
            auto.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            auto.add_word(phrase, (len(phrase), None))
        auto.make_automaton()
        return auto

    def features(self, auto, text: str | None) -> tuple[float, float, float]:
        if auto is None:
            return 0.0, 0.0, 0.0
        t = folded(text)
        found: dict[int, float] = {}
        spared = []
        for end, (n, w) in auto.iter(t):
            start = end - n + 1
            if w is None:
                spared.append((start, end + 1))
            else:  # of a word's entries the heaviest counts
                found[start] = max(w, found.get(start, 0.0))
        if spared:  # an exception's last blank belongs to what follows
            inside, reach = sorted(spared), -1
            k = 0
            for s in sorted(found):
                while k < len(inside) and inside[k][0] <= s:
                    reach = max(reach, inside[k][1] - 1)
                    k += 1
                if s < reach:
                    del found[s]
        total = sum(found.values())
        n = max(1, t.count(" ") - 1)
        return total, total / n**0.5, 100.0 * total / n

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.final[0] + x @ np.array(self.final[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _counted(rows: DataFrame, candidates) -> DataFrame:
    """term, pos, neg: documents of either class that hold a candidate. candidates: text -> set of terms."""

    def count(batches):
        for p in batches:
            pos: dict[str, int] = {}
            neg: dict[str, int] = {}
            for t, y in zip(p["text"], p["y"], strict=True):
                into = pos if y else neg
                for c in candidates(t):
                    into[c] = into.get(c, 0) + 1
            keys = list({**pos, **neg})
            yield pd.DataFrame({"term": keys, "pos": [pos.get(k, 0) for k in keys], "neg": [neg.get(k, 0) for k in keys]})

    made = rows.select("text", "y").mapInPandas(count, row_type(term="string", pos="long", neg="long"))
    return made.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[float, ...]:
    """Weights of a logistic regression on scaled features, as for the raw ones; Newton steps with a small penalty."""
    scale = np.abs(x).max(axis=0)
    scale[scale == 0] = 1
    a, w = np.column_stack([np.ones(len(x)), x / scale]), np.zeros(x.shape[1] + 1)
    for _ in range(min(steps, 30)):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 0.05 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return (float(w[0]), *(w[1:] / scale).tolist())


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column | None = None, per_class: int = 15_000, min_docs: int = 4, max_terms: int = 20_000) -> Lexicon:
    """A lexicon from a bounded sample of labelled rows; train_rows is in terms of the column k (a doc_id)."""
    rows = durable(labelled_sample(docs, labels, "toxic", F.lit(True) if train_rows is None else train_rows, per_class), "toxicity-sample")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return Lexicon()
    weight = F.log(((F.col("pos") + 0.1) / n[1]) / ((F.col("neg") + 0.1) / n[0]))
    found = _counted(rows, lambda t: terms(set(folded(t).split())))
    found = found.where(F.col("pos") >= min_docs).withColumn("w", weight).where(F.col("w") > 3.0)
    top = found.orderBy(F.col("w").desc(), "term").limit(max_terms).collect()
    lexicon = Lexicon({r["term"]: float(r["w"]) for r in top})
    # entries that clean documents hold too: which neighbours set them apart
    mixed = {r["term"] for r in top if r["neg"] > 0}
    if mixed:
        def phrases(text):
            w = folded(text).split()
            return {f" {p} {c} " for a, b in zip(w, w[1:], strict=False) if f" {a} " in mixed or f" {b} " in mixed for p, c in [(a, b)]}

        clean = _counted(rows, phrases).where((F.col("neg") >= 3) & (F.col("pos") == 0)).orderBy(F.col("neg").desc(), "term").limit(max_terms).collect()
        lexicon.exceptions = tuple(r["term"] for r in clean)
    auto_of = rows.select("y", features(rows, lexicon)(F.col("text")).alias("f")).select("y", "f.*").toPandas()
    x, y = auto_of[["total", "by_root", "by_length"]].to_numpy(), auto_of["y"].to_numpy()
    lexicon.final = _logistic(x, y)
    return lexicon


def features(docs: DataFrame, lexicon: Lexicon):
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf(row_type(total="double", by_root="double", by_length="double"))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = shared.value.automaton()
        for s in batches:
            yield pd.DataFrame([shared.value.features(auto, t) for t in s], columns=["total", "by_root", "by_length"], dtype=float)

    return run


def scorer(docs: DataFrame, lexicon: Lexicon):
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        auto = model.automaton()
        for s in batches:
            x = np.array([model.features(auto, t) for t in s], dtype=float).reshape(-1, 3)
            yield pd.Series(model.probability(x))

    return run


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: held_out, score and predicted."""
    lexicon = fit(docs, labels, fold(F.col("k"), 5) != 0)
    out = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), scorer(docs, lexicon)(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
