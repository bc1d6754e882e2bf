"""Edit-aware token counts.

A document's text is cut into leaves at places where the tokenizer's pre-token
pattern always breaks: before white space that follows something else, and before
a mark of punctuation that follows a letter or digit. Token counts of such leaves
add up to the count of the whole text, whatever the byte pairs. A segment tree
holds the counts; an edit re-encodes only the leaves that it touches with the
characters that its neighbours need as context, and updates the sums above them.

A tree is kept per document as two columns beside the text, the characters and
the tokens of each leaf (``trees``); ``edited`` takes them up again and applies
edits to text and tree without encoding the rest of the text.

The vocabulary is a file of byte-pair ranks at a path that is a parameter; it is
read, never trained.

Defined results: null and empty texts have no tokens and no leaves. An edit
beyond the text's end is cut to the text. Special tokens in a text count as plain
text. A very long run without any such place is one leaf, as its byte pairs
depend on all of it. Rows that repeat are counted one by one, alike; an empty
table gives no rows; other columns are not read, but for those that ``trees`` and
``edited`` name, which are replaced.
"""
from __future__ import annotations

import base64
import functools
import itertools
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import list_of, row_type

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 512
#: Letters of which any version of the character tables says so.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-Ρα-ωА-яぁ-ゖァ-ヺ一-龥가-힣"
_BREAK = re.compile(rf"(?<=\S)(?=[ \t\n\r])|(?<=[{_LETTERS}0-9])(?=[.,;:!?()\[\]。，、；：！？「」])")


@functools.cache
def encoder(path: str = VOCABULARY):
    """Function from a text to its number of tokens."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def leaves(text: str, size: int = LEAF) -> list[str]:
    """Parts of about size characters or more, broken only where pre-tokens always break."""
    out, at = [], 0
    while at < len(text):
        m = _BREAK.search(text, at + size)
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


class CountTree:
    """Segment tree over leaves: token and character sums, and edits."""

    def __init__(self, text: str, count, size: int = LEAF, kept: tuple[list[int], list[int]] | None = None):
        """kept: characters and tokens of the leaves, from a tree of this text; without them all of the text is encoded."""
        self.count, self.leaf_size, self.encoded = count, size, 0
        if kept is None:
            self.texts = leaves(text, size)
            self._build([self._count(t) for t in self.texts])
        else:
            ends = list(itertools.accumulate(kept[0], initial=0))
            self.texts = [text[a:b] for a, b in itertools.pairwise(ends)]
            self._build(list(kept[1]))
        self.encoded = 0

    def kept(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves."""
        own = [i for i, t in enumerate(self.texts) if t]
        return [len(self.texts[i]) for i in own], [self.tokens[self.width + i] for i in own]

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return self.count(text)

    def _build(self, counts: list[int]) -> None:
        self.width = 1
        while self.width < len(self.texts):
            self.width *= 2
        self.tokens, self.chars = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (t, n) in enumerate(zip(self.texts, counts, strict=True)):
            self.tokens[self.width + i], self.chars[self.width + i] = n, len(t)
        for i in range(self.width - 1, 0, -1):
            self._pull(i)

    def _pull(self, i: int) -> None:
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def locate(self, at: int) -> tuple[int, int]:
        """(leaf, offset in it) of a character."""
        i = 1
        while i < self.width:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.width, at

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters start to end by new."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        if not self.texts:
            self.texts = leaves(new, self.leaf_size)
            self._build([self._count(t) for t in self.texts])
            return
        # two characters of context on either side decide whether a break holds
        first, offset = self.locate(max(0, start - 2))
        last, _ = self.locate(min(self.n_chars - 1, end + 2))
        base = max(0, start - 2) - offset
        old = "".join(self.texts[first : last + 1])
        made = leaves(old[: start - base] + new + old[end - base :], self.leaf_size)
        slots = last - first + 1
        if len(made) > slots:  # leaves are dealt anew, counts of the others kept
            before, after = ([(self.texts[i], self.tokens[self.width + i]) for i in some if self.texts[i]] for some in (range(first), range(last + 1, len(self.texts))))
            dealt = [*before, *((t, self._count(t)) for t in made), *after]
            self.texts = [t for t, _ in dealt]
            self._build([n for _, n in dealt])
            return
        made += [""] * (slots - len(made))
        for i, t in zip(range(first, last + 1), made, strict=True):
            self.texts[i] = t
            self.tokens[self.width + i], self.chars[self.width + i] = self._count(t) if t else 0, len(t)
        lo, hi = (self.width + first) // 2, (self.width + last) // 2
        while lo:
            for i in range(lo, hi + 1):
                self._pull(i)
            lo, hi = lo // 2, hi // 2


def planned_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits that op5 applies to any text: a word goes, a note comes in, and a run is put in upper case."""
    n = len(text)
    return [(n // 3, min(n, n // 3 + 7), ""), (n // 2, n // 2, " [note: revised]"), (3 * n // 4, 3 * n // 4 + 24, text[3 * n // 4 : 3 * n // 4 + 24].upper())]


_TREE = row_type(chars=list_of("int"), tokens=list_of("int"))
_EDITED = row_type(text="string", tree=_TREE, n_edits="long", n_reencoded="long")


def build(vocabulary: str = VOCABULARY, size: int = LEAF):
    """Column function: the tree of a text."""

    @F.pandas_udf(_TREE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = encoder(vocabulary)
        for s in batches:
            yield pd.DataFrame([CountTree(t or "", count, size).kept() for t in s], columns=_TREE.names)

    return run


def edit(edits, vocabulary: str = VOCABULARY):
    """Column function of a text and its tree: both after the edits (start, end, new) that edits(text) gives, in this order."""

    @F.pandas_udf(_EDITED)
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        count = encoder(vocabulary)
        for texts, trees in batches:
            rows = []
            for t, chars, tokens in zip(texts, trees["chars"], trees["tokens"], strict=True):
                tree, todo = CountTree(t or "", count, kept=(list(chars), list(tokens))), edits(t or "")
                for e in todo:
                    tree.edit(*e)
                rows.append((tree.text, dict(zip(_TREE.names, tree.kept(), strict=True)), len(todo), tree.encoded))
            yield pd.DataFrame(rows, columns=_EDITED.names)

    return run


def trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with tree, the leaves' characters and tokens."""
    return docs.withColumn("tree", build(vocabulary)(F.col("text")))


def edited(kept: DataFrame, edits, vocabulary: str = VOCABULARY) -> DataFrame:
    """kept (text, tree, ...) after the edits, with n_edits and n_reencoded, the characters that were encoded again."""
    names = ("text", "tree", "n_edits", "n_reencoded")
    x = kept.select(*[F.col(f"`{c}`") for c in kept.columns if c not in names], edit(edits, vocabulary)(F.col("text"), F.col("tree")).alias("tree"))
    return x.select(*[F.col(f"`{c}`") for c in x.columns if c != "tree"], *[F.col(f"tree.{n}").alias(n) for n in names])


def total(values) -> F.Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v)


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, edits=planned_edits) -> DataFrame:
    """Per document: tokens before and after its edits, and how many characters the edits made it encode again."""
    kept = trees(docs.select("doc_id", "text"), vocabulary)
    kept = kept.select("doc_id", "text", "tree", total("tree.chars").alias("n_chars"), F.size("tree.chars").cast("long").alias("n_leaves"), total("tree.tokens").alias("n_tokens"))
    out = edited(kept, edits, vocabulary)
    return out.select("doc_id", "n_chars", "n_leaves", "n_tokens", "n_edits", total("tree.chars").alias("n_chars_after"), total("tree.tokens").alias("n_tokens_after"), F.col("n_reencoded").alias("n_chars_reencoded"))
