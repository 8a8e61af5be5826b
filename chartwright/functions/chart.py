"""Parse charts of one sentence over an acyclic automaton: a line, or all edits within a radius.

The automaton's states are numbered so that arcs go up. An arc carries a predicate on tokens: one
token, any token but one, or any. A cell (p, q) is a bit set of nonterminals that derive some string
from p to q; the closure visits cells by q and then falling p, so each is final when it is used. The
parents of two bit sets are remembered, as few distinct pairs occur.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

from chartwright.functions.grammar import EMPTY, HOLE, START, Grammar

EQ, NE, ANY = 0, 1, 2
#: Greatest edit radius, and the bound on a sentence's length in the automaton's terms.
MAX_RADIUS, MAX_WIDTH = 5, 128


class Tables:
    """A grammar as bit sets; made once for each task."""

    def __init__(self, g: Grammar) -> None:
        self.names = list(g.nonterminals)
        self.ids = {a: i for i, a in enumerate(self.names)}
        self.start = 1 << self.ids[START]
        self.words = {self.ids[a]: ts for a, ts in g.tokens.items()}
        self.of_token: dict[str, int] = {}
        for a, t in g.unit:
            self.of_token[t] = self.of_token.get(t, 0) | 1 << self.ids[a]
        self.any = sum(1 << a for a in self.words)
        self.single = {ts[0]: 0 for ts in self.words.values() if len(ts) == 1}
        for a, ts in self.words.items():
            if len(ts) == 1:
                self.single[ts[0]] |= 1 << a
        self.by_left: dict[int, list[tuple[int, int]]] = {}
        self.rules: dict[int, list[tuple[int, int]]] = {}
        for a, b, c in g.binary:
            a, b, c = self.ids[a], self.ids[b], self.ids[c]
            self.by_left.setdefault(b, []).append((c, 1 << a))
            self.rules.setdefault(a, []).append((b, c))
        self.parents = lru_cache(maxsize=200_000)(self._parents)

    def _parents(self, left: int, right: int) -> int:
        out = 0
        for b in bits(left):
            for c, a in self.by_left.get(b, ()):
                if right >> c & 1:
                    out |= a
        return out

    def leaf(self, kind: int, token: str | None) -> int:
        if kind == EQ:
            return self.of_token.get(token, 0)
        return self.any & ~self.single.get(token, 0) if kind == NE else self.any

    def choices(self, a: int, kind: int, token: str | None) -> list[str]:
        """Tokens of nonterminal a that satisfy a predicate, sorted."""
        own = self.words.get(a, [])
        return [t for t in own if t == token] if kind == EQ else [t for t in own if t != token] if kind == NE else own


def bits(x: int):
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def line_arcs(tokens: list[str]) -> list[tuple[int, int, int, str | None]]:
    """(p, q, kind, token) of the automaton of one sentence; a hole is any token, a stub its own token."""
    return [(i, i + 1, ANY if t == HOLE else EQ, None if t == HOLE else t) for i, t in enumerate(tokens)]


def edit_states(n: int, radius: int) -> list[tuple[int, int]]:
    """(position, edits) of the states, in order."""
    return sorted(((i, j) for i in range(n + 1) for j in range(radius + 1)), key=lambda s: (s[0] + s[1], s[0]))


def edit_arcs(tokens: list[str], radius: int) -> list[tuple[int, int, int, str | None]]:
    """Arcs of the automaton of all strings within an edit radius; a string's path is the canonical one, so none has two of equal cost."""
    n = len(tokens)
    at = {s: k for k, s in enumerate(edit_states(n, radius))}
    out = []
    for (i, j), p in at.items():
        here = tokens[i] if i < n else None
        if j < radius:
            out.append((p, at[i, j + 1], ANY if here is None else NE, here))
        if i < n:
            out.append((p, at[i + 1, j], EQ, here))
            if j < radius:
                out.append((p, at[i + 1, j + 1], NE, here))
        out += [(p, at[i + d + 1, j + d], EQ, tokens[i + d]) for d in range(1, radius - j + 1) if i + d < n]
    return out


class Chart:
    """The closed chart of an automaton. cells[p][q] is a bit set; leaves[p, q] the arc's predicate."""

    def __init__(self, tables: Tables, n_states: int, arcs: list[tuple[int, int, int, str | None]]) -> None:
        self.t, self.n = tables, n_states
        self.leaves = {(p, q): (kind, token) for p, q, kind, token in arcs}
        cells: list[dict[int, int]] = [{} for _ in range(n_states)]
        into: list[int] = [0] * n_states
        out_of: list[int] = [0] * n_states
        by_end: list[dict[int, int]] = [{} for _ in range(n_states)]
        for (p, q), (kind, token) in self.leaves.items():
            by_end[q][p] = tables.leaf(kind, token)
        parents = tables.parents
        for q in range(n_states):
            for p in range(q - 1, -1, -1):
                got = by_end[q].get(p, 0)
                for m in bits(out_of[p] & into[q]):
                    got |= parents(cells[p][m], cells[m][q])
                if got:
                    cells[p][q] = got
                    out_of[p] |= 1 << q
                    into[q] |= 1 << p
        self.cells = cells
        self._sizes: dict[tuple[int, int, int], int] = {}
        self._best: dict[tuple[int, int, int], list[tuple[str, ...]]] = {}
        self._plain: dict[tuple, list[tuple[str, ...]]] = {}
        self._extrema: dict[tuple[int, int, int], dict] = {}

    def has(self, p: int, q: int, a: int | None = None) -> bool:
        a = self.t.ids[START] if a is None else a
        return bool(self.cells[p].get(q, 0) >> a & 1)

    def backs(self, p: int, q: int, a: int):
        """(m, b, c) of the ways to derive a from p to q by a binary rule."""
        for m in sorted(self.cells[p]):
            if p < m < q and q in self.cells[m]:
                left, right = self.cells[p][m], self.cells[m][q]
                for b, c in self.t.rules.get(a, ()):
                    if left >> b & 1 and right >> c & 1:
                        yield m, b, c

    def leaf_tokens(self, p: int, q: int, a: int) -> list[str]:
        return self.t.choices(a, *self.leaves[p, q]) if (p, q) in self.leaves else []

    def size(self, p: int, q: int, a: int) -> int:
        """Number of derivations, exact."""
        if (p, q, a) not in self._sizes:
            self._sizes[p, q, a] = len(self.leaf_tokens(p, q, a)) + sum(self.size(p, m, b) * self.size(m, q, c) for m, b, c in self.backs(p, q, a))
        return self._sizes[p, q, a]

    def best(self, p: int, q: int, a: int, k: int) -> list[tuple[str, ...]]:
        """The k least strings by (length, tokens). A string's parts are among the k least of theirs, so nothing is lost."""
        if (p, q, a) not in self._best:
            found = {(t,) for t in self.leaf_tokens(p, q, a)}
            for m, b, c in self.backs(p, q, a):
                rights = self.best(m, q, c, k)
                found.update(x + y for x in self.best(p, m, b, k) for y in rights)
                if len(found) > 4 * k * k:
                    found = set(heapq.nsmallest(k, found, key=lambda s: (len(s), s)))
            self._best[p, q, a] = heapq.nsmallest(k, found, key=lambda s: (len(s), s))
        return self._best[p, q, a]

    def plain(self, p: int, q: int, a: int, k: int | None) -> list[tuple[str, ...]]:
        """The k least strings (all, for none) by (length, tokens), ε left out, each once. ε neither lengthens a string nor tells two apart, so a string's parts are among the k least of theirs."""
        key = (p, q, a, k)
        if key not in self._plain:
            order = lambda s: (len(s), s)
            found = {() if t == EMPTY else (t,) for t in self.leaf_tokens(p, q, a)}
            for m, b, c in self.backs(p, q, a):
                rights = self.plain(m, q, c, k)
                found.update(x + y for x in self.plain(p, m, b, k) for y in rights)
                if k is not None and len(found) > 4 * k * k:
                    found = set(heapq.nsmallest(k, found, key=order))
            self._plain[key] = sorted(found, key=order) if k is None else heapq.nsmallest(k, found, key=order)
        return self._plain[key]

    def extrema(self, p: int, q: int, a: int) -> dict[int, tuple[tuple[str, ...], tuple[str, ...]]]:
        """The least and the greatest string of each visible length, ε left out."""
        if (p, q, a) not in self._extrema:
            found: dict[int, tuple] = {}

            def add(lo: tuple[str, ...], hi: tuple[str, ...]) -> None:
                x, y = found.get(len(lo), (lo, hi))
                found[len(lo)] = (min(x, lo), max(y, hi))

            for t in self.leaf_tokens(p, q, a):
                s = () if t == EMPTY else (t,)
                add(s, s)
            for m, b, c in self.backs(p, q, a):
                for x, y in self.extrema(p, m, b).values():
                    for v, w in self.extrema(m, q, c).values():
                        add(x + v, y + w)
            self._extrema[p, q, a] = found
        return self._extrema[p, q, a]

    def unrank(self, p: int, q: int, a: int, rank: int) -> tuple[str, ...]:
        """The derivation of a rank below size(p, q, a), as its string."""
        leaves = self.leaf_tokens(p, q, a)
        if rank < len(leaves):
            return (leaves[rank],)
        rank -= len(leaves)
        for m, b, c in self.backs(p, q, a):
            right = self.size(m, q, c)
            both = self.size(p, m, b) * right
            if rank < both:
                return self.unrank(p, m, b, rank // right) + self.unrank(m, q, c, rank % right)
            rank -= both
        raise IndexError("rank is beyond the number of derivations")

    def tree(self, p: int, q: int, a: int) -> tuple:
        """(name, p, q, children) of one derivation: a leaf if there is one, else by the least (m, b, c)."""
        leaves = self.leaf_tokens(p, q, a)
        if leaves:
            return (leaves[0], p, q, ())
        m, b, c = next(self.backs(p, q, a))
        return (self.t.names[a], p, q, (self.tree(p, m, b), self.tree(m, q, c)))


def line_chart(tables: Tables, tokens: list[str]) -> Chart:
    return Chart(tables, len(tokens) + 1, line_arcs(tokens))


def edit_roots(tables: Tables, tokens: list[str], radius: int) -> tuple[Chart, list[tuple[int, int]]]:
    """The chart of all strings within the radius, and (state, distance) of the final states where START ends, nearest first."""
    n = len(tokens)
    chart = Chart(tables, (n + 1) * (radius + 1), edit_arcs(tokens, radius))
    finals = [(k, n - i + j) for k, (i, j) in enumerate(edit_states(n, radius)) if n - i + j <= radius]
    return chart, sorted(((k, d) for k, d in finals if k and chart.has(0, k)), key=lambda x: (x[1], x[0]))


def flattened(tree: tuple) -> tuple:
    """A tree without the helper nodes of the normal form."""
    name, p, q, kids = tree
    out = []
    for kid in (flattened(k) for k in kids):
        out += kid[3] if kid[3] and ("." in kid[0] or kid[0] == "ε+") else [kid]
    return (name, p, q, tuple(out))


def drawn(tree: tuple, indent: str = "") -> str:
    """A tree as text, nodes with their first and last position."""
    name, p, q, kids = tree
    lines = [f"{name} [{p}..{q - 1}]" if kids else name]
    for i, kid in enumerate(kids):
        last = i == len(kids) - 1
        text = drawn(kid).split("\n")
        lines += [("└── " if last else "├── ") + text[0], *(("    " if last else "│   ") + x for x in text[1:])]
    return "\n".join(indent + x for x in lines)


def maximal_spans(chart: Chart, names: set[str] | None = None) -> list[tuple[int, int, str]]:
    """(p, q, nonterminal) of the widest cells, none inside another; helper nonterminals don't count."""
    own = {i for i, a in enumerate(chart.t.names) if "." not in a and a != "ε+" and (names is None or a in names)}
    found: list[tuple[int, int, str]] = []
    every = sorted(((p, q) for p in range(chart.n) for q in chart.cells[p]), key=lambda s: (s[0] - s[1], s[0]))
    for p, q in every:
        if any(x <= p and q <= y for x, y, _ in found):
            continue
        if ids := [a for a in bits(chart.cells[p][q]) if a in own]:
            found.append((p, q, min(chart.t.names[a] for a in ids)))
    return sorted(found)
