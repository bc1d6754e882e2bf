"""Regular expressions compiled to minimal deterministic automata over bytes.

``compile_rules`` parses each rule, joins all of them in one nondeterministic
automaton, builds the subset automaton over classes of equivalent bytes, and
minimises it by partition refinement. Supported syntax: literals, escapes \\xHH
\\d \\w, [classes], (groups), |, and the repeats ? * + {m} {m,} {m,n}.
"""
from __future__ import annotations

_DIGIT = frozenset(range(0x30, 0x3A))
_WORD = _DIGIT | frozenset(range(0x41, 0x5B)) | frozenset(range(0x61, 0x7B)) | {0x5F}


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        node = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return node

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat(self.atom()))
        return ("cat", parts)

    def atom(self):
        c = self.peek()
        self.i += 1
        if c == "(":
            node = self.alternatives()
            if self.peek() != ")":
                raise ValueError("missing )")
            self.i += 1
            return node
        if c == "[":
            return ("set", self.char_class())
        if c == "\\":
            return ("set", self.escape())
        return ("set", frozenset([ord(c)]))

    def escape(self) -> frozenset[int]:
        c = self.peek()
        self.i += 1
        if c == "x":
            self.i += 2
            return frozenset([int(self.p[self.i - 2 : self.i], 16)])
        return {"d": _DIGIT, "w": _WORD}.get(c, frozenset([ord(c)]))

    def char_class(self) -> frozenset[int]:
        negated = self.peek() == "^"
        self.i += negated
        out: set[int] = set()
        while self.peek() != "]":
            c = self.peek()
            self.i += 1
            one = self.escape() if c == "\\" else frozenset([ord(c)])
            if len(one) == 1 and self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                last = self.peek()
                self.i += 1
                hi = next(iter(self.escape())) if last == "\\" else ord(last)
                one = frozenset(range(next(iter(one)), hi + 1))
            out |= one
        self.i += 1
        return frozenset(range(256)) - out if negated else frozenset(out)

    def repeat(self, node):
        while self.peek() and self.peek() in "?*+{":
            c = self.peek()
            self.i += 1
            lo, hi = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
            if c == "{":
                end = self.p.index("}", self.i)
                a, comma, b = self.p[self.i : end].partition(",")
                lo, hi, self.i = int(a), (int(b) if b else None if comma else int(a)), end + 1
            node = ("rep", node, lo, hi)
        return node


def _reverse(node):
    if node[0] == "cat":
        return ("cat", [_reverse(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [_reverse(x) for x in node[1]])
    return ("rep", _reverse(node[1]), *node[2:]) if node[0] == "rep" else node


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.moves.append(None)
        return len(self.eps) - 1

    def add(self, node, start: int) -> int:
        """Appends node after start; the state where it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            here = self.state()
            self.eps[start].append(here)
            self.moves[here] = (node[1], end)
            return end
        if kind == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                here = self.state()
                self.eps[start].append(here)
                self.eps[self.add(x, here)].append(end)
            return end
        _, inner, lo, hi = node
        for _ in range(lo):
            start = self.add(inner, start)
        if hi is None:
            loop = self.state()
            self.eps[start].append(loop)
            self.eps[self.add(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.eps[start].append(end)
        for _ in range(hi - lo):
            start = self.add(inner, start)
            self.eps[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for n in self.eps[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


class Dfa:
    """table[state][byte] is the next state; accepts[state] a bit set of rules; dead is the state that nothing leaves (-1 if absent)."""

    def __init__(self, table: list[list[int]], accepts: list[int], start: int):
        self.table, self.accepts, self.start = table, accepts, start
        self.dead = next((s for s, row in enumerate(table) if not accepts[s] and set(row) == {s}), -1)

    def linked(self) -> list:
        """The start state as a transition array: row[byte] is the next row, row[256] the accepted rules."""
        rows: list[list] = [[] for _ in self.table]
        for row, targets, accept in zip(rows, self.table, self.accepts, strict=True):
            row.extend([rows[t] for t in targets])
            row.append(accept)
        return rows[self.start]


def compile_rules(patterns: list[str], unanchored: bool = False, backwards: bool = False) -> Dfa:
    nfa = _Nfa()
    start, final = nfa.state(), {}
    for rule, pattern in enumerate(patterns):
        tree = _Parser(pattern).parse()
        here = nfa.state()
        nfa.eps[start].append(here)
        end = nfa.add(_reverse(tree) if backwards else tree, here)
        final[end] = final.get(end, 0) | 1 << rule
    if unanchored:
        again = nfa.state()
        nfa.eps[start].append(again)
        nfa.moves[again] = (frozenset(range(256)), start)
    # bytes that no set tells apart are one symbol
    sets = {m[0] for m in nfa.moves if m}
    kinds: dict[tuple, list[int]] = {}
    for b in range(256):
        kinds.setdefault(tuple(b in s for s in sets), []).append(b)
    symbols = list(kinds.values())
    first = nfa.closure([start])
    number, todo, rows = {first: 0}, [first], []
    while todo:
        states, todo_next = todo, []
        for subset in states:
            row = []
            for symbol in symbols:
                target = nfa.closure([nfa.moves[s][1] for s in subset if nfa.moves[s] and symbol[0] in nfa.moves[s][0]])
                if target not in number:
                    number[target] = len(number)
                    todo_next.append(target)
                row.append(number[target])
            rows.append(row)
        todo = todo_next
    accepts = [0] * len(number)
    for subset, n in number.items():
        for s in subset:
            accepts[n] |= final.get(s, 0)
    # minimisation: split blocks until their members agree on the blocks they lead to
    block = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    of = [block[a] for a in accepts]
    while True:
        signatures: dict[tuple, int] = {}
        new = [signatures.setdefault((of[s], *(of[t] for t in rows[s])), len(signatures)) for s in range(len(rows))]
        if len(signatures) == len(set(of)):
            break
        of = new
    size = max(of) + 1
    table: list[list[int]] = [[0] * 256 for _ in range(size)]
    out = [0] * size
    for s, row in enumerate(rows):
        out[of[s]] = accepts[s]
        for symbol, t in zip(symbols, row, strict=True):
            for b in symbol:
                table[of[s]][b] = of[t]
    return Dfa(table, out, of[0])
