"""Grammars: text to productions, productions to a binary normal form, and both as small tables.

A rule is a line `A -> x y | z`; lines without an arrow are comments; tokens are separated by blanks; a
symbol on some left side is a nonterminal, any other a terminal. Text before a line `---` is the
grammar, lines after it are sentences. `_` in a sentence is a hole, `<A>` a stub for nonterminal A.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Rule = tuple[str, tuple[str, ...]]

#: Fixed values of the notation.
START, ARROW, BAR, RULE_LINE, HOLE, EMPTY, PAD, LIFTED = "START", "->", "|", "---", "_", "ε", "ε+", "F."


def split_document(text: str) -> tuple[str, list[str]]:
    """Grammar text and sentences of a document."""
    lines = text.split("\n")
    at = next((i for i, x in enumerate(lines) if x.strip() == RULE_LINE), len(lines))
    return "\n".join(lines[:at]), [x.strip() for x in lines[at + 1 :] if x.strip()]


def parse_rules(text: str) -> list[Rule]:
    """The rules in order, repeats left out; an empty alternative derives ε. START derives every nonterminal if it has no rule."""
    rules: dict[Rule, None] = {}
    for line in text.split("\n"):
        words = line.split()
        if ARROW not in words:
            continue
        at = words.index(ARROW)
        if at != 1:
            raise ValueError(f"a rule has one symbol on its left: {line.strip()}")
        right: list[str] = []
        for w in [*words[2:], BAR]:
            if w == BAR:
                rules[words[0], tuple(right) or (EMPTY,)] = None
                right = []
            else:
                right.append(w)
    left = list(dict.fromkeys(a for a, _ in rules))
    if rules and START not in left:
        rules = {**{(START, (a,)): None for a in left}, **rules}
    return list(rules)


@dataclass(frozen=True)
class Grammar:
    """A grammar in normal form: binary rules A -> B C and unit rules A -> token."""

    rules: tuple[Rule, ...]
    binary: tuple[tuple[str, str, str], ...]
    unit: tuple[tuple[str, str], ...]
    nonterminals: tuple[str, ...] = field(default=())

    @property
    def tokens(self) -> dict[str, list[str]]:
        """Sorted tokens of each nonterminal."""
        out: dict[str, list[str]] = {}
        for a, t in sorted(self.unit):
            out.setdefault(a, []).append(t)
        return out

    @property
    def terminals(self) -> set[str]:
        return {t for _, t in self.unit}

    def size(self) -> tuple[int, int, int]:
        """Nonterminals, terminals and productions of the normal form."""
        names = {a for a, _ in self.unit} | {x for r in self.binary for x in r}
        return len(names), len(self.terminals), len(self.binary) + len(self.unit)

    def frames(self, spark: SparkSession, gid: str = "g") -> dict[str, DataFrame]:
        """Tables productions, bin, unit and symbols; lit is a token's place in its nonterminal's sorted tokens, from 1."""
        ids = {a: i for i, a in enumerate(self.nonterminals)}
        terms = sorted(self.terminals)
        return {
            "productions": spark.createDataFrame([(gid, i, a, list(r)) for i, (a, r) in enumerate(self.rules)], "gid string, pid int, lhs string, rhs array<string>"),
            "bin": spark.createDataFrame([(gid, ids[a], ids[b], ids[c]) for a, b, c in self.binary], "gid string, a int, b int, c int"),
            "unit": spark.createDataFrame([(gid, ids[a], t, i + 1) for a, ts in self.tokens.items() for i, t in enumerate(ts)], "gid string, a int, tok string, lit int"),
            "symbols": spark.createDataFrame([(gid, "nonterminal", a, i) for a, i in ids.items()] + [(gid, "terminal", t, i) for i, t in enumerate(terms)], "gid string, kind string, sym string, id int"),
        }


def normal_form(rules: Iterable[Rule], epsilons: bool = False, stubs: bool = False) -> Grammar:
    """Binary normal form of rules with a START.

    Nonterminals that occur only as whole right sides vanish into START, which inherits what they
    derive. With epsilons, the others may be followed by any number of ε tokens; with stubs, each of
    them derives its own stub. Long right sides are split from the left, their tails named by their
    symbols; terminals in them are lifted.
    """
    rules = list(rules)
    left = {a for a, _ in rules}
    inner = {x for _, r in rules if len(r) > 1 for x in r if x in left}
    whole: dict[str, set[tuple[str, ...]]] = {a: set() for a in left}
    unit_of: dict[str, set[str]] = {a: set() for a in left}
    for a, r in rules:
        if len(r) == 1 and r[0] in left:
            unit_of[a].add(r[0])
        else:
            whole[a].add(r)
    if epsilons:
        for v in inner - {START}:
            whole[v].add((v, PAD))
        whole[PAD] = {(PAD, PAD), (EMPTY,)}
        unit_of[PAD] = set()
        whole.setdefault(START, set()).add((START, EMPTY))
        left = left | {PAD}
    kept = {START, *inner} | ({PAD} if epsilons else set())

    def closure(a: str) -> set[str]:
        seen, todo = {a}, [a]
        while todo:
            for b in unit_of.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    closed = {a: {r for b in closure(a) for r in whole.get(b, ())} for a in kept}
    if stubs:
        for v in inner - {START}:
            closed[v].add((f"<{v}>",))
    binary: set[tuple[str, str, str]] = set()
    unit: set[tuple[str, str]] = set()

    def lifted(x: str) -> str:
        if x in left:
            return x
        unit.add((LIFTED + x, x))
        return LIFTED + x

    def add(a: str, r: tuple[str, ...]) -> None:
        if len(r) == 1:
            unit.add((a, r[0]))
        elif len(r) == 2:
            binary.add((a, lifted(r[0]), lifted(r[1])))
        else:
            tail = ".".join(r[1:])
            if (a, lifted(r[0]), tail) not in binary:
                binary.add((a, lifted(r[0]), tail))
                add(tail, r[1:])

    for a, rs in closed.items():
        for r in rs:
            add(a, r)
    names = sorted({a for a, _ in unit} | {x for r in binary for x in r} | {START}, key=lambda a: (a != START, a))
    return Grammar(tuple(rules), tuple(sorted(binary)), tuple(sorted(unit)), tuple(names))


def load(text: str, epsilons: bool = False, stubs: bool = False) -> Grammar:
    """The normal form of the grammar part of a document."""
    return normal_form(parse_rules(split_document(text)[0]), epsilons, stubs)


def load_normal(text: str) -> Grammar:
    """A grammar written in normal form already, taken as it is."""
    rules = parse_rules(split_document(text)[0])
    left = {a for a, _ in rules}
    binary = tuple(sorted((a, *r) for a, r in rules if len(r) == 2))
    unit = tuple(sorted((a, r[0]) for a, r in rules if len(r) == 1 and r[0] not in left))
    names = sorted({a for a, _ in unit} | {x for r in binary for x in r} | {START}, key=lambda a: (a != START, a))
    return Grammar(tuple(rules), binary, unit, tuple(names))


def stages(text: str, epsilons: bool = False, stubs: bool = False) -> list[tuple[str, int, int, int]]:
    """(form, nonterminals, terminals, productions) of the original and the normal form."""
    rules = parse_rules(split_document(text)[0])
    left = {a for a, _ in rules}
    right = {x for _, r in rules for x in r}
    return [("original", len(left), len(right - left), len(rules)), ("normal", *normal_form(rules, epsilons, stubs).size())]


def meta_grammar(names: Iterable[str]) -> Grammar:
    """A grammar of grammar lines over given symbols: a nonterminal, an arrow, alternatives of symbols. START stands as [START]."""
    symbols = sorted({f"[{START}]" if x == START else x for x in names} - {ARROW, BAR})
    rules: list[Rule] = [(START, ("Symbol", "Right")), ("Right", (ARROW, "Body")), ("Body", ("Body", BAR, "Body")), ("Body", ("Symbol", "Body")), ("Body", ("Symbol",))]
    return normal_form([*rules, *(("Symbol", (x,)) for x in symbols)])
