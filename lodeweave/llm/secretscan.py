"""Secret scans with one combined deterministic automaton.

All rules are compiled into one minimal transition table (``automaton``). One
pass over the bytes of a text finds where matches of any rule end; a small
reversed automaton of the rule then gives the leftmost start that does not
overlap the rule's previous match, and its anchored automaton the longest end.
Matches of a rule are leftmost, longest and do not overlap each other; rules are
independent. A rule may drop matches that are too short once they are found.

Defined results: null and empty texts have no spans. Offsets are code points,
ends exclusive. Very long texts are scanned whole, in one pass. Rows that repeat
are scanned one by one, alike; an empty table gives no rows; other columns, of
whatever name, are not read by ``secrets`` and stay as they are in ``redact``.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import list_of, row_type
from .automaton import compile_rules


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: least length of a match, or of what stands after value_after if that is set
    least: int = 1
    value_after: bytes = b""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base rules, in the order in which their kinds are listed.
BASE = (
    Rule("assign", f"({_either('password')}|{_either('passwd')}|{_either('secret')}|{_either('token')}|{_either('api')}_?{_either('key')})[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", 6, b":="),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    # a greedy run that is dropped below a length is a run of at least that length; the pass then stops at long runs only
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Further rules, after public formats of tokens and keys.
MORE = (
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("git_token", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", 15),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE):
        self.rules = rules
        patterns = [r.pattern for r in rules]
        # a match's later bytes are found by its own automaton, so the pass only needs where matches first end
        self.combined = compile_rules(patterns, unanchored=True)
        self.row = self.combined.linked()
        self.forward = [compile_rules([p]) for p in patterns]
        self.backward = [compile_rules([p], backwards=True) for p in patterns]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start and rule; short matches dropped."""
        out: list[tuple[int, int, int]] = []
        row, done, at = self.row, [0] * len(self.rules), 0
        for b in data:
            row = row[b]
            at += 1
            if hit := row[256]:
                while hit:
                    low = hit & -hit
                    hit ^= low
                    k = low.bit_length() - 1
                    if at > done[k] and (start := self._start(k, data, at, done[k])) >= 0:
                        done[k] = self._end(k, data, start)
                        if self._long_enough(k, data, start, done[k]):
                            out.append((start, done[k], k))
        return sorted(out, key=lambda x: (x[0], x[2]))

    def _start(self, k: int, data: bytes, end: int, floor: int) -> int:
        d, best = self.backward[k], -1
        s, table, i = d.start, d.table, end
        while i > floor:
            i -= 1
            s = table[s][data[i]]
            if s == d.dead:
                break
            if d.accepts[s]:
                best = i
        return best

    def _end(self, k: int, data: bytes, start: int) -> int:
        d = self.forward[k]
        s, table, best = d.start, d.table, start
        for i in range(start, len(data)):
            s = table[s][data[i]]
            if s == d.dead:
                break
            if d.accepts[s]:
                best = i + 1
        return best

    def _long_enough(self, k: int, data: bytes, start: int, end: int) -> bool:
        rule, match = self.rules[k], data[start:end]
        if rule.value_after:
            cut = min(i for c in rule.value_after if (i := match.find(c)) >= 0)
            match = match[cut + 1 :].lstrip(b" ")
            match = match[1:] if match[:1] in (b'"', b"'") else match
        return len(match) >= rule.least


_SCHEMA = row_type(spans=list_of(row_type(kind="string", start="int", end="int")))


def scan(text: F.Column | str, rules: tuple[Rule, ...] = BASE + MORE) -> F.Column:
    """Column of struct(spans): all matches of all rules in a text column."""

    @F.pandas_udf(_SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(rules)
        for s in batches:
            rows = []
            for t in s:
                data = t.encode("utf-8", "surrogatepass") if t else b""
                found, points, last = [], 0, 0
                spans = scanner.spans(data)
                if len(data) == len(t or ""):
                    found = [{"kind": rules[k].kind, "start": a, "end": e} for a, e, k in spans]
                else:
                    for a, e, k in spans:  # starts ascend, so code points are counted on from the last one
                        points += len(data[last:a].decode("utf-8", "surrogatepass"))
                        last = a
                        found.append({"kind": rules[k].kind, "start": points, "end": points + len(data[a:e].decode("utf-8", "surrogatepass"))})
                rows.append(found)
            yield pd.DataFrame({"spans": rows})

    return run(text)


@F.pandas_udf(row_type(n_assign="long", n_access="long", n_hex="long", base_sha256="string", spans="string"))
def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    base = [r.kind for r in BASE]
    for p in batches:
        rows = []
        for spans in p["spans"]:
            own = [s for s in spans if s["kind"] in base]
            joined = lambda some: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in some)
            rows.append((*(sum(s["kind"] == k for s in own) for k in base), hashlib.sha256(joined(own).encode()).hexdigest(), joined(spans)))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Per document: counts of the base kinds, digest of their spans, and all spans."""
    return docs.select("doc_id", _digest(scan(F.col("text"), rules)).alias("s")).select("doc_id", "s.*")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by a mark."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(rules)
        for s in batches:
            out = []
            for t in s:
                if not t:
                    out.append(t)
                    continue
                data, parts, last = t.encode("utf-8", "surrogatepass"), [], 0
                for a, e, _ in scanner.spans(data):
                    if a >= last:
                        parts += [data[last:a], mark.encode()]
                    last = max(last, e)
                out.append(b"".join([*parts, data[last:]]).decode("utf-8", "surrogatepass"))
            yield pd.Series(out)

    return docs.withColumn("text", run(F.col("text")))
