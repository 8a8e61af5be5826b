"""Repairs within an edit radius, completions of holes, suffixes and completion plans.

Strings come ranked by (distance, length, tokens); each is given once, at its least distance.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

from pyspark.sql import DataFrame

from chartwright.functions import chart as C
from chartwright.functions.grammar import HOLE, START, Grammar
from chartwright.operators.runner import per_sentence
from chartwright.operators.scoring import SCALE

TOP = 29


def widest(radius: int) -> int:
    """Greatest number of tokens of a sentence to repair: its automaton's width, height and ten more fit the bound."""
    if not 0 <= radius <= C.MAX_RADIUS:
        raise ValueError(f"the radius is 0 to {C.MAX_RADIUS}")
    return C.MAX_WIDTH - radius - 12


def nearest(sentences: DataFrame, grammar: Grammar, radius: int = 2) -> DataFrame:
    """Sentences with some string of the language within the radius: led, its distance, and n_derivations of all at that state."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        chart, roots = C.edit_roots(t, tokens, radius)
        return [(roots[0][1], str(sum(chart.size(0, k, t.ids[START]) for k, d in roots if d == roots[0][1])))] if roots else []

    return per_sentence(sentences, grammar, one, "led int, n_derivations string", most=widest(radius))


def repaired(t: C.Tables, tokens: list[str], radius: int, buffer: int, k: int) -> list[tuple[int, tuple[str, ...]]]:
    """The k nearest strings. Of each root the k least, ε left out, that no nearer root has: as many more are asked for as nearer ones are known."""
    chart, roots = C.edit_roots(t, tokens, radius)
    found: dict[tuple[str, ...], int] = {}
    for q, d in roots:
        if d <= roots[0][1] + buffer:
            for s in chart.plain(0, q, t.ids[START], k + len(found)):
                found.setdefault(s, d)
    return sorted(((d, s) for s, d in found.items()), key=lambda x: (x[0], len(x[1]), x[1]))[:k]


def root_sizes(sentences: DataFrame, grammar: Grammar, radius: int = 2) -> DataFrame:
    """Rows (dist, n_derivations): how many derivations end at the final states of each distance."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        chart, roots = C.edit_roots(t, tokens, radius)
        sizes: dict[int, int] = {}
        for q, d in roots:
            sizes[d] = sizes.get(d, 0) + chart.size(0, q, t.ids[START])
        return [(d, str(n)) for d, n in sorted(sizes.items())]

    return per_sentence(sentences, grammar, one, "dist int, n_derivations string", most=widest(radius))


def distances(sentences: DataFrame, grammar: Grammar, radius: int = 2) -> DataFrame:
    """Rows (dist, n_words): how many different strings of the language are at each distance of a sentence, within the radius."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        chart, roots = C.edit_roots(t, tokens, radius)
        found: dict[tuple[str, ...], int] = {}
        for q, d in roots:
            for s in chart.plain(0, q, t.ids[START], None):
                found.setdefault(s, d)
        return sorted(Counter(found.values()).items())

    return per_sentence(sentences, grammar, one, "dist int, n_words long", most=widest(radius))


def saturation(sentences: DataFrame, grammar: Grammar, radius: int = 2, buffer: int = 1, k: int = TOP) -> DataFrame:
    """Adds share: the strings that repairs() would give, by the derivations at their roots."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        chart, roots = C.edit_roots(t, tokens, radius)
        total = sum(chart.size(0, q, t.ids[START]) for q, d in roots if d <= roots[0][1] + buffer)
        return [(len(repaired(t, tokens, radius, buffer, k)) / total,)] if total else []

    return per_sentence(sentences, grammar, one, "share double", most=widest(radius))


def repairs(sentences: DataFrame, grammar: Grammar, radius: int = 2, buffer: int = 1, k: int = TOP) -> DataFrame:
    """The k nearest strings of each sentence, up to buffer beyond the least distance: rank, dist, repair."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        return [(i + 1, d, list(s)) for i, (d, s) in enumerate(repaired(t, tokens, radius, buffer, k))]

    return per_sentence(sentences, grammar, one, "rank int, dist int, repair array<string>", most=widest(radius))


def completions(sentences: DataFrame, grammar: Grammar, k: int = TOP) -> DataFrame:
    """The k least ways to fill the holes: rank, completion. ε tokens are left out, and equal strings then given once."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        chart = C.line_chart(t, tokens)
        if not chart.has(0, len(tokens)):
            return []
        return [(i + 1, list(s)) for i, s in enumerate(chart.plain(0, len(tokens), t.ids[START], k))]

    return per_sentence(sentences, grammar, one, "rank int, completion array<string>")


def sampled(sentences: DataFrame, grammar: Grammar, n: int, seed: int = 0) -> DataFrame:
    """n derivations of each sentence's completions, drawn without replacement by a keyed permutation of their ranks: nth, word."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        chart = C.line_chart(t, tokens)
        if not chart.has(0, len(tokens)):
            return []
        a = t.ids[START]
        size = chart.size(0, len(tokens), a)
        return [(i, list(chart.unrank(0, len(tokens), a, permuted(i, size, seed)))) for i in range(min(n, size))]

    return per_sentence(sentences, grammar, one, "nth int, word array<string>")


def permuted(i: int, n: int, seed: int) -> int:
    """A permutation of 0..n-1: four rounds that mix the two halves of the number, repeated until the result is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        hi, lo = i >> half, i & mask
        for r in range(4):
            x = (lo * 0x9E3779B97F4A7C15 + seed * 0xD6E8FEB86659FD93 + r * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
            x ^= x >> 31
            hi, lo = lo, hi ^ ((x * 0x94D049BB133111EB >> 17) & mask)
        i = hi << half | lo
        if i < n:
            return i


def stub_strings(sentences: DataFrame, grammar: Grammar, k: int = 50, most: int = 12) -> DataFrame:
    """For sentences of one stub <A>: the k least strings of A up to a length: rank, string."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        a = t.ids.get(tokens[0][1:-1]) if len(tokens) == 1 and tokens[0][:1] == "<" else None
        if a is None:
            return []
        chart, found = C.line_chart(t, [HOLE] * most), []
        for n in range(1, most + 1):
            if chart.has(0, n, a):
                found += chart.best(0, n, a, k)
            if len(found) >= k:
                break
        return [(i + 1, list(s)) for i, s in enumerate(found[:k])]

    return per_sentence(sentences, grammar, one, "rank int, string array<string>")


def suffix_lengths(t: C.Tables, tokens: list[str], most: int) -> list[int]:
    """The numbers of further tokens, up to most, that can end the sentence."""
    chart = C.line_chart(t, tokens + [HOLE] * most)
    return [h for h in range(most + 1) if len(tokens) + h and chart.has(0, len(tokens) + h)]


def suffixes(sentences: DataFrame, grammar: Grammar, k: int = TOP, most: int = 6) -> DataFrame:
    """The k least endings of sentences that are prefixes: rank, suffix, and lengths (all possible up to most)."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        n = len(tokens)
        lengths = suffix_lengths(t, tokens, most)
        chart, found = C.line_chart(t, tokens + [HOLE] * most), []
        for h in lengths:
            found += [s[n:] for s in chart.best(0, n + h, t.ids[START], k)]
        return [(i + 1, list(s), lengths) for i, s in enumerate(found[:k])]

    return per_sentence(sentences, grammar, one, "rank int, suffix array<string>, lengths array<int>")


def common_prefix(words: list[str]) -> str:
    """The longest common prefix of strings, from the least and the greatest of them."""
    if not words:
        return ""
    a, b = min(words), max(words)
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def completion_plan(t: C.Tables, tokens: list[str], most: int = 20, branches: int = 3) -> tuple | None:
    """How the last token, typed in part, may go on: (expanded prefix, number of candidates, committed, forced continuation, branches).

    Candidates are terminals with that prefix from which some ending of at most `most` tokens exists. The
    forced continuation is what all shortest and longer endings share, up to the shortest one's length.
    """
    *before, typed = tokens
    viable = []
    for w in sorted(x for x in t.of_token if x.startswith(typed) and not (x.startswith("<") and x.endswith(">"))):
        if lengths := suffix_lengths(t, [*before, w], most):
            viable.append((w, lengths))
    if not viable:
        return None
    committed = len(viable) == 1
    expanded = viable[0][0] if committed else common_prefix([w for w, _ in viable])
    forced: list[str] = []
    if committed:
        n, lengths = len(tokens), viable[0][1]
        chart = C.line_chart(t, [*before, expanded] + [HOLE] * most)
        ends = []
        for h in lengths:
            least = chart.best(0, n + h, t.ids[START], 1)[0][n:]
            ends += [least, greatest(chart, n + h)[n:]]
        for parts in zip(*ends, strict=False):
            if len(set(parts)) > 1:
                break
            forced.append(parts[0])
    order = sorted(viable, key=lambda x: (x[0] != typed, x[1][0], x[0]))[:branches]
    return expanded, len(viable), committed, forced, [(w, [*before, w], lengths) for w, lengths in order]


def greatest(chart: C.Chart, q: int) -> tuple[str, ...]:
    """The lexicographically greatest string of a root; all of a root's strings are of one length on a line."""
    memo: dict[tuple[int, int, int], tuple[str, ...]] = {}

    def top(p: int, q: int, a: int) -> tuple[str, ...]:
        if (p, q, a) not in memo:
            found = [(x,) for x in chart.leaf_tokens(p, q, a)] + [top(p, m, b) + top(m, q, c) for m, b, c in chart.backs(p, q, a)]
            memo[p, q, a] = max(found)
        return memo[p, q, a]

    return top(0, q, chart.t.ids[START])


PLAN = "expanded string, candidates int, committed boolean, forced array<string>, branches array<struct<terminal:string,tokens:array<string>,suffix_lengths:array<int>>>"


def plans(sentences: DataFrame, grammar: Grammar, most: int = 20) -> DataFrame:
    """The completion plan of each sentence whose last token can be continued."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        got = completion_plan(t, tokens, most)
        return [(*got[:4], [{"terminal": w, "tokens": ts, "suffix_lengths": ls} for w, ts, ls in got[4]])] if got else []

    return per_sentence(sentences, grammar, one, PLAN)


#: A parent's greatest weight by cost alone, most successors that count, and the greatest weight.
BY_COST, BRANCHES, HEAVIEST = 4096, 64, 65_535


def parent_weight(cost: int | None, successors: int, scale: int) -> int:
    """How likely a state of the frontier is to be drawn: less with its cost so far, more with its successors; 0 for a dead one."""
    if cost is None:
        return 0
    return min(HEAVIEST, max(1, BY_COST // (1 + cost // max(scale, 1))) * min(max(successors, 1), BRANCHES))


def _uniform(*of: object) -> float:
    """A number in (0, 1), the same for the same arguments in any process."""
    return (int.from_bytes(hashlib.blake2b(repr(of).encode(), digest_size=8).digest(), "big") + 0.5) / 2.0**64


def frontier(t: C.Tables, chart: C.Chart, q: int, width: int, k: int, most: int = 264, automaton=None, seed: int | None = None) -> list[tuple[str, ...]]:
    """Strings of a root by leftmost derivation: states are what is emitted and a stack of cells still to derive.

    While there are at most width states all are kept, and all strings of up to `most` steps found. Beyond
    it a run is a beam: without a seed those that emitted least stay, then by their tokens; with one, states
    are drawn by parent_weight() of the automaton's cost (0 without one), and each then goes on by one
    successor, a token with mass exp(-cost / scale), an expansion with 1. Either way a run is repeatable.
    Chart.plain() gives all of a root's least strings, whatever their number.
    """
    states: list[tuple[tuple[str, ...], tuple[tuple[int, int, int], ...]]] = [((), ((0, q, t.ids[START]),))]
    done: dict[tuple[str, ...], None] = {}
    step_cost = lambda out, token: automaton.edges.get((automaton.state(out), token), (0, automaton.missing))[1] if automaton else 0
    scale = SCALE if automaton else 1
    for n in range(most):
        if len(states) > width and seed is not None:
            heavy = [(parent_weight(automaton.cost(s[0]) if automaton else 0, len(chart.leaf_tokens(*s[1][0])) + sum(1 for _ in chart.backs(*s[1][0])), scale), s) for s in states]
            # the states of the least -log(u) / weight are a weighted draw without replacement
            states = [s for _, s in sorted((-math.log(_uniform(seed, n, s)) / w, s) for w, s in heavy if w)[:width]]
            one_each = True
        else:
            one_each = False
        grown = set()
        for out, stack in states:
            (p, r, a), rest = stack[0], stack[1:]
            after = [(math.exp(-step_cost(out, token) / scale) if one_each else 1.0, ((*out, token), rest)) for token in chart.leaf_tokens(p, r, a)]
            after += [(1.0, (out, ((p, m, b), (m, r, c), *rest))) for m, b, c in chart.backs(p, r, a)]
            if one_each and after:
                after = [min(after, key=lambda x, here=(out, stack), n=n: -math.log(_uniform(seed, n, here, x[1])) / max(x[0], 1e-300))]
            for _, s in after:
                if s[1]:
                    grown.add(s)
                else:
                    done[s[0]] = None
        states = sorted(grown, key=lambda s: (len(s[0]) + len(s[1]), s))
        if seed is None:
            states = states[:width]
        if not states or len(done) >= k:
            break
    return sorted(done, key=lambda s: (len(s), s))[:k]


def beam(sentences: DataFrame, grammar: Grammar, width: int = 2000, k: int = TOP, automaton=None, seed: int | None = None) -> DataFrame:
    """Completions by a bounded frontier instead of whole cells: rank, completion. All of them while the frontier fits its width; completions() has no such bound."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        chart = C.line_chart(t, tokens)
        return [(i + 1, list(s)) for i, s in enumerate(frontier(t, chart, len(tokens), width, k, automaton=automaton, seed=seed))] if chart.has(0, len(tokens)) else []

    return per_sentence(sentences, grammar, one, "rank int, completion array<string>")


def yield_bounds(sentences: DataFrame, grammar: Grammar) -> DataFrame:
    """The lexicographically least and greatest completion of each sentence: least, greatest."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        chart = C.line_chart(t, tokens)
        n = len(tokens)
        return [(list(chart.best(0, n, t.ids[START], 1)[0]), list(greatest(chart, n)))] if chart.has(0, n) else []

    return per_sentence(sentences, grammar, one, "least array<string>, greatest array<string>")


def bounds_by_length(sentences: DataFrame, grammar: Grammar) -> DataFrame:
    """The lexicographically least and greatest completion of each visible length, that is without ε: length, least, greatest."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        chart = C.line_chart(t, tokens)
        if not chart.has(0, len(tokens)):
            return []
        return [(n, list(lo), list(hi)) for n, (lo, hi) in sorted(chart.extrema(0, len(tokens), t.ids[START]).items())]

    return per_sentence(sentences, grammar, one, "length int, least array<string>, greatest array<string>")
