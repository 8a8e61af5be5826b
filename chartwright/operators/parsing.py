"""Membership, trees, ambiguity, active cells, segments. Sentences have a column tokens (array of strings); other columns are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwright.functions import chart as C
from chartwright.functions.grammar import HOLE, START, Grammar
from chartwright.operators.runner import per_sentence

#: Fixed value: greatest number of tokens that can end a sentence.
SUFFIX = 20


def accept(sentences: DataFrame, grammar: Grammar) -> DataFrame:
    """Adds accepted: whether the grammar derives the sentence."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        return [(C.line_chart(t, tokens).has(0, len(tokens)),)]

    found = per_sentence(sentences, grammar, one, "accepted boolean", "left")
    return found.withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def tree_counts(sentences: DataFrame, grammar: Grammar) -> DataFrame:
    """Adds n_trees: the number of derivations, decimal(38,0), greatest value where it is larger."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        chart = C.line_chart(t, tokens)
        return [(str(min(chart.size(0, len(tokens), t.ids[START]), 10**38 - 1) if chart.has(0, len(tokens)) else 0),)]

    found = per_sentence(sentences, grammar, one, "n_trees string", "left")
    return found.withColumn("n_trees", F.coalesce(F.col("n_trees").cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))


def trees(sentences: DataFrame, grammar: Grammar) -> DataFrame:
    """Accepted sentences with tree: one parse tree as text, nodes with their first and last position."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        chart = C.line_chart(t, tokens)
        return [(C.drawn(C.flattened(chart.tree(0, len(tokens), t.ids[START]))),)] if chart.has(0, len(tokens)) else []

    return per_sentence(sentences, grammar, one, "tree string")


def tree_nodes(sentences: DataFrame, grammar: Grammar) -> DataFrame:
    """Accepted sentences with the nodes of one tree: node, parent (null at the root), label, lo, hi (end exclusive)."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        chart = C.line_chart(t, tokens)
        if not chart.has(0, len(tokens)):
            return []
        rows: list[tuple] = []

        def walk(tree: tuple, parent: int | None) -> None:
            me = len(rows)
            rows.append((me, parent, tree[0], tree[1], tree[2]))
            for kid in tree[3]:
                walk(kid, me)

        walk(C.flattened(chart.tree(0, len(tokens), t.ids[START])), None)
        return rows

    return per_sentence(sentences, grammar, one, "node int, parent int, label string, lo int, hi int")


def cells(sentences: DataFrame, grammar: Grammar) -> DataFrame:
    """A row for each cell of the chart: q, q2 and nt."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        chart = C.line_chart(t, tokens)
        return [(p, q, t.names[a]) for p in range(chart.n) for q, x in chart.cells[p].items() for a in C.bits(x)]

    return per_sentence(sentences, grammar, one, "q int, q2 int, nt string")


def back_pointers(sentences: DataFrame, grammar: Grammar) -> DataFrame:
    """A row for each binary derivation step of each cell: q, q2, nt, m, b, c."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        chart = C.line_chart(t, tokens)
        return [(p, q, t.names[a], m, t.names[b], t.names[c]) for p in range(chart.n) for q, x in chart.cells[p].items() for a in C.bits(x) for m, b, c in chart.backs(p, q, a)]

    return per_sentence(sentences, grammar, one, "q int, q2 int, nt string, m int, b string, c string")


def maximal_subtrees(sentences: DataFrame, grammar: Grammar) -> DataFrame:
    """The widest parseable spans, none inside another: lo, hi (end exclusive), label."""
    return per_sentence(sentences, grammar, lambda t, tokens: C.maximal_spans(C.line_chart(t, tokens)), "lo int, hi int, label string")


def segments(sentences: DataFrame, grammar: Grammar) -> DataFrame:
    """Each token's region: lo, hi and kind (illegal: no token of the grammar; parseable: a widest span of two tokens or more; unparseable: the rest)."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        kinds = ["unparseable" if x in t.of_token or x == HOLE else "illegal" for x in tokens]
        marks: list[tuple[str, int]] = [(k, -1) for k in kinds]
        for n, (p, q, _) in enumerate(C.maximal_spans(C.line_chart(t, tokens))):
            if q - p > 1 or len(tokens) == 1:
                marks[p:q] = [("parseable", n)] * (q - p)
        out, lo = [], 0
        for i in range(1, len(marks) + 1):
            if i == len(marks) or marks[i] != marks[lo]:
                out.append((lo, i, marks[lo][0]))
                lo = i
        return out

    return per_sentence(sentences, grammar, one, "lo int, hi int, kind string")


def scenarios(sentences: DataFrame, grammar: Grammar, suffix: bool = False) -> DataFrame:
    """Adds scenario: STUB (one stub alone), COMPLETION (a hole or a stub), with suffix SUFFIX_COMPLETION (a known prefix that can go on or end), PARSEABLE, or REPAIR."""
    hole = F.array_contains("tokens", HOLE) | F.exists("tokens", lambda x: x.rlike(r"^<\S+>$"))
    alone = (F.size("tokens") == 1) & F.element_at("tokens", 1).rlike(r"^<\S+>$")

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        n = len(tokens)
        ends = C.line_chart(t, tokens + [HOLE] * (SUFFIX if suffix else 0))
        lengths = [h for h in range(SUFFIX + 1 if suffix else 1) if ends.has(0, n + h)]
        return [(bool(lengths) and lengths[0] == 0, bool(lengths))]

    found = per_sentence(sentences.where(F.size("tokens") > 0), grammar, one, "_whole boolean, _goes_on boolean")
    named = F.when(alone, "STUB").when(hole, "COMPLETION").when(F.lit(suffix) & F.col("_goes_on"), "SUFFIX_COMPLETION").when(F.col("_whole"), "PARSEABLE").otherwise("REPAIR")
    return found.withColumn("scenario", named).drop("_whole", "_goes_on")


def max_fragment(sentences: DataFrame, grammar: Grammar, pad: int = 3) -> DataFrame:
    """The longest prefix and the longest suffix that extend to a sentence with at most pad more tokens: prefix and suffix, numbers of tokens."""

    def one(t: C.Tables, tokens: list[str]) -> list[tuple]:
        n = len(tokens)
        after, before = C.line_chart(t, tokens + [HOLE] * pad), C.line_chart(t, [HOLE] * pad + tokens)
        fits = lambda k: any(C.line_chart(t, tokens[:k] + [HOLE] * h).has(0, k + h) for h in range(pad + 1)) if k else True
        whole = any(after.has(0, n + h) for h in range(pad + 1))
        prefix = n if whole else max((k for k in range(n) if fits(k)), default=0)
        back = lambda k: any(C.line_chart(t, [HOLE] * h + tokens[n - k :]).has(0, k + h) for h in range(pad + 1)) if k else True
        suffix = n if any(before.has(pad - h, pad + n) for h in range(pad + 1)) else max((k for k in range(n) if back(k)), default=0)
        return [(prefix, suffix)]

    return per_sentence(sentences, grammar, one, "prefix int, suffix int")
