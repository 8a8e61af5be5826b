"""Normal form, charts, repairs and completions against known values and brute force."""

import itertools

import pytest

from chartwright.functions import chart as C
from chartwright.functions.grammar import START, load, normal_form, parse_rules, split_document, stages
from chartwright.operators.repairing import completion_plan, permuted, repaired

#: The worked example of the notation, its sizes, and its repairs.
IF = """
 S -> X
 X -> I | F | P
 P -> I O I
 F -> IF | BF
IF -> if B then I else I
BF -> if B then B else B
 O -> + | - | * | /
 I -> 1 | 2 | 3 | 4 | IF
 N -> !
 B -> true | false | B BO B | ( B ) | BF | N B
BO -> and | or
"""


def test_sizes_of_the_worked_example():
    assert stages(IF, True, True) == [("original", 12, 18, 38), ("normal", 24, 24, 72)]


def test_helper_names():
    g = normal_form(parse_rules(IF), True, True)
    assert ("B.then.I.else.I", "B", "then.I.else.I") in g.binary and ("BO.B", "BO", "B") in g.binary
    assert ("F.if", "if") in g.unit and ("ε+", "ε") in g.unit and ("O", "<O>") in g.unit
    assert (START, "START", "F.ε") in g.binary and not any(t.startswith("<") for a, t in g.unit if a == START)


def test_document_and_wrong_rules():
    assert split_document("A -> b\n---\nb\n\n b b ") == ("A -> b", ["b", "b b"])
    with pytest.raises(ValueError):
        parse_rules("A B -> c")
    assert parse_rules("only a comment") == []


def test_tree_of_the_worked_example():
    t = C.Tables(load(IF))
    tokens = "if true then if true then 1 else 2 else 3".split()
    chart = C.line_chart(t, tokens)
    assert C.drawn(C.flattened(chart.tree(0, len(tokens), t.ids[START]))).split("\n")[0:5] == ["START [0..10]", "├── if", "├── true", "├── then", "├── I [3..8]"]


@pytest.mark.parametrize("fix", ["if ( true or false ) then <I> else 1", "if ( true or false ) then true else <B>", "if ( true or false ) then true else ! <B>"])
def test_repairs_of_the_worked_example(fix):
    t = C.Tables(load(IF, False, True))
    found = repaired(t, "if ( true or false ) then true else 1".split(), 2, 1, 200)
    assert tuple(fix.split()) in [s for _, s in found]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


SMALL = ["START -> a b | a START b | c", "START -> START START | a | b c", "START -> A B\nA -> a | A a\nB -> b | c B"]


@pytest.mark.parametrize("text", SMALL)
def test_repairs_are_those_of_brute_force(text):
    g = load(text)
    t = C.Tables(g)
    sigma = sorted(g.terminals)
    words = [w for n in range(1, 6) for w in itertools.product(sigma, repeat=n)]
    language = [w for w in words if C.line_chart(t, list(w)).has(0, len(w))]
    for w in [w for w in words if len(w) <= 3]:
        near = sorted(((edit(w, s), len(s), s) for s in language if edit(w, s) <= 2))
        want = [(d, s) for d, _, s in near if d <= near[0][0] + 1] if near else []
        assert repaired(t, list(w), 2, 1, 10_000) == want


@pytest.mark.parametrize("text", SMALL)
def test_membership_counts_and_ranks(text):
    g = load(text)
    t = C.Tables(g)
    sigma = sorted(g.terminals)
    for n in range(1, 5):
        chart = C.line_chart(t, ["_"] * n)
        every = [w for w in itertools.product(sigma, repeat=n) if C.line_chart(t, list(w)).has(0, n)]
        if not every:
            assert not chart.has(0, n)
            continue
        size = chart.size(0, n, t.ids[START])
        assert set(chart.best(0, n, t.ids[START], 1000)) == set(every)
        drawn = [chart.unrank(0, n, t.ids[START], permuted(i, size, 7)) for i in range(size)]
        assert set(drawn) == set(every) and sorted(permuted(i, size, 7) for i in range(size)) == list(range(size))
        assert size == sum(C.line_chart(t, list(w)).size(0, n, t.ids[START]) for w in every)


def test_states_and_arcs_of_the_edit_automaton():
    assert len(C.edit_states(36, 5)) == 222
    arcs = C.edit_arcs(["a"] * 36, 5)
    assert len(arcs) == 37 * 5 + 36 * 6 + 36 * 5 + sum(max(0, 36 - d) * (6 - d) for d in range(1, 6))


def plan_of(text, line):
    return completion_plan(C.Tables(load(text)), line.split())


def test_completion_plans():
    got = plan_of("START -> begin Table x | other Taco q", "begin Tab")
    assert got[0] == "Table" and got[2] and got[4][0][2] == [1]
    assert plan_of("START -> if ( value x | if ( value y", "i")[3] == ["(", "value"]
    assert plan_of("START -> if ( | if ( x", "i")[3] == ["("]
    assert plan_of("START -> if ( x | if (( y", "i")[3] == []
    got = plan_of("START -> if ( x | ifdef ( y", "i")
    assert got[0] == "if" and not got[2]
    assert plan_of("START -> begin Table z | other Taco q", "begin Tac") is None
    got = plan_of("START -> begin Table x | begin Target y | begin Task z | begin Tail w | end Toe v", "begin T")
    assert got[0] == "Ta" and got[1] == 4 and len(got[4]) == 3
    assert [b[2] for b in plan_of("START -> begin Table x | begin Target y z", "begin Ta")[4]] == [[1], [2]]


def test_frontier_finds_what_cells_do():
    from chartwright.operators.repairing import frontier

    t = C.Tables(load("START -> a b | a START b | c | START START"))
    chart = C.line_chart(t, ["_"] * 4)
    assert set(frontier(t, chart, 4, 10_000, 10_000)) == set(chart.best(0, 4, t.ids[START], 10_000))
    assert len(frontier(t, chart, 4, 3, 2)) <= 2


def test_meta_grammar():
    from chartwright.functions.grammar import meta_grammar

    t = C.Tables(meta_grammar(["A", "b", "START"]))
    for line, ok in (("A -> b | A b", True), ("[START] -> A", True), ("A ->", False), ("-> b", False), ("A b", False)):
        assert C.line_chart(t, line.split()).has(0, len(line.split())) == ok
