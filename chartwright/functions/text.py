"""Columns and functions on tokens: splitting, holes, edit distance, alignment, signatures, lexing, restitching."""

from __future__ import annotations

import io
import re
import tokenize as pytokenize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartwright.functions.grammar import EMPTY, HOLE

STUB = r"^<\S+>$"


def tokenise(text: Column) -> Column:
    """Tokens between blanks."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def abstracted(tokens: Column, terminals: list[str]) -> Column:
    """Tokens that the grammar lacks, and that are no stub, as holes."""
    return F.transform(tokens, lambda t: F.when(t.isin(terminals) | t.rlike(STUB), t).otherwise(F.lit(HOLE)))


def code_points(tokens: Column, terminals: list[str]) -> Column:
    """Places of tokens in the sorted terminals, from 1; -1 for a hole; an unknown token raises an error."""
    ids = F.create_map(*(F.lit(x) for i, t in enumerate(sorted(terminals)) for x in (t, i + 1)))
    return F.transform(tokens, lambda t: F.when(t == HOLE, -1).otherwise(F.coalesce(F.try_element_at(ids, t), F.raise_error(F.concat(F.lit("unknown token "), t)).cast("int"))))


def without_empty(tokens: Column) -> Column:
    return F.array_remove(tokens, EMPTY)


def has_stub(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: t.rlike(STUB))


def coded(tokens: Column, terminals: list[str]) -> Column:
    """One ASCII character a token, for levenshtein(); tokens that are not listed share the last."""
    known = sorted(set(terminals))
    if len(known) > 90:
        raise ValueError("at most 90 different tokens can be coded")
    ids = F.create_map(*(F.lit(x) for i, t in enumerate(known) for x in (t, chr(33 + i))))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(ids, t), F.lit("~"))), "")


def token_distance(a: Column, b: Column, terminals: list[str]) -> Column:
    """Token edit distance; holes of a don't count."""
    return F.levenshtein(coded(F.array_remove(a, HOLE), terminals), coded(b, terminals))


def alignment(old: list[str], new: list[str]) -> list[tuple[str | None, str | None]]:
    """Pairs (old, new) of a cheapest alignment, None for an insertion or a deletion; substitutions come before deletions before insertions."""
    n, m = len(old), len(new)
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            if i < n and j < m:
                cost[i][j] = min(cost[i + 1][j + 1] + (old[i] != new[j]), cost[i + 1][j] + 1, cost[i][j + 1] + 1)
            else:
                cost[i][j] = n - i + m - j
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and cost[i][j] == cost[i + 1][j + 1] + (old[i] != new[j]):
            out.append((old[i], new[j]))
            i, j = i + 1, j + 1
        elif i < n and cost[i][j] == cost[i + 1][j] + 1:
            out.append((old[i], None))
            i += 1
        else:
            out.append((None, new[j]))
            j += 1
    return out


def kind_of(token: str) -> str:
    """Abstract class of a token in a signature: its own text for punctuation, WORD otherwise."""
    return "WORD" if re.fullmatch(r"\w+", token) else token


def signature(pairs: list[tuple[str | None, str | None]], abstract: bool = False) -> str:
    """E for an equal token, I.x for an insertion, D for a deletion, C.x for a change; trailing equals left out of the abstract form."""
    name = kind_of if abstract else (lambda x: x)
    return " ".join("E" if a == b else f"I.{name(b)}" if a is None else "D" if b is None else f"C.{name(b)}" for a, b in pairs)


def painted(pairs: list[tuple[str | None, str | None]]) -> str:
    """The new tokens with insertions as +x, changes as ~x and deletions as -x."""
    return " ".join(b if a == b else f"+{b}" if a is None else f"-{a}" if b is None else f"~{b}" for a, b in pairs)


def _pairs(f):
    @F.pandas_udf(T.StringType())
    def udf(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([f(alignment(list(a), list(b))) if a is not None and b is not None else None for a, b in zip(old, new, strict=True)])

    return udf


def edit_signature(old: Column, new: Column, abstract: bool = False) -> Column:
    return _pairs(lambda p: signature(p, abstract))(old, new)


def painted_diff(old: Column, new: Column) -> Column:
    return _pairs(painted)(old, new)


def labels(doc: list[str], query: list[str]) -> list[int]:
    """For each token of doc what it costs in a cheapest alignment with query: 0 equal, 1 inserted, 2 changed; changes come before insertions before deletions, from the end."""
    n, m = len(doc), len(query)
    cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + 2 * (doc[i - 1] != query[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [0] * n, n, m
    while i:
        change = 2 * (doc[i - 1] != query[j - 1]) if j else 0
        if j and cost[i][j] == cost[i - 1][j - 1] + change:
            out[i - 1] = change
            i, j = i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + 1:
            out[i - 1] = 1
            i -= 1
        else:
            j -= 1
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def alignment_labels(doc: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([labels(list(a), list(b)) if a is not None and b is not None else None for a, b in zip(doc, query, strict=True)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("old", T.StringType()), T.StructField("new", T.StringType())])))
def aligned(old: pd.Series, new: pd.Series) -> pd.Series:
    """The pairs of a cheapest alignment."""
    return pd.Series([[{"old": x, "new": y} for x, y in alignment(list(a), list(b))] if a is not None and b is not None else None for a, b in zip(old, new, strict=True)])


def surrounding(line: str, at: int, pattern: str = r"\S+") -> str | None:
    """The match of a pattern that the caret position at touches, the first of two."""
    return next((m[0] for m in re.finditer(pattern, line) if m.start() <= at <= m.end()), None)


def surrounding_token(line: Column, at: Column) -> Column:
    """The token that a caret position (from 0) touches."""
    return _surrounding(r"\S+")(line, at)


def surrounding_nonterminal(line: Column, at: Column) -> Column:
    """The stub <A> that a caret position (from 0) touches."""
    return _surrounding(r"<[^\s>]+>")(line, at)


def _surrounding(pattern: str):
    @F.pandas_udf(T.StringType())
    def udf(lines: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([surrounding(a, int(i), pattern) if a is not None else None for a, i in zip(lines, places, strict=True)])

    return udf


def compilable(line: Column) -> Column:
    """A line of token classes with a number and a string in place of those classes."""
    return F.replace(F.replace(line, F.lit("NUMBER"), F.lit("1")), F.lit("STRING"), F.lit('""'))


def lcp(words: Column) -> Column:
    """Longest common prefix of an array of strings: that of the least and the greatest."""
    a, b = F.array_min(words), F.array_max(words)
    n = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.length(a) >= i) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(k))
    return F.substring(a, F.lit(1), n)


def lexed(line: str) -> list[tuple[str, str]]:
    """(class, text) of the tokens of a line of Python, NEWLINE last; operators and keywords are their own class."""
    import keyword

    out = []
    try:
        for t in pytokenize.generate_tokens(io.StringIO(line).readline):
            if t.type in (pytokenize.NAME, pytokenize.NUMBER, pytokenize.STRING, pytokenize.OP):
                own = t.type == pytokenize.OP or keyword.iskeyword(t.string)
                out.append((t.string if own else pytokenize.tok_name[t.type], t.string))
    except (pytokenize.TokenError, IndentationError, SyntaxError):
        known = " ".join(x for _, x in out)
        if not known:
            out = [(x if not x.isidentifier() else "NAME", x) for x in re.findall(r"\w+|\S", line)]
    return [*out, ("NEWLINE", "")]


def restitched(line: str, repaired: list[str]) -> str:
    """The repaired classes with the texts that the line's tokens had; a new class stands for itself."""
    tokens = lexed(line)
    pairs = alignment([k for k, _ in tokens], repaired)
    texts, i = [], 0
    for old, new in pairs:
        text = tokens[i][1] if old is not None else None
        i += old is not None
        if new is not None and new != "NEWLINE":
            texts.append(text if old == new else new)
    return " ".join(x for x in texts if x)


@F.pandas_udf(T.ArrayType(T.StringType()))
def lex_classes(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: [k for k, _ in lexed(x or "")])


@F.pandas_udf(T.StringType())
def restitch(lines: pd.Series, repaired: pd.Series) -> pd.Series:
    return pd.Series([restitched(a or "", list(b)) for a, b in zip(lines, repaired, strict=True)])


@F.pandas_udf(T.StringType())
def compile_error(lines: pd.Series) -> pd.Series:
    """Null if a line compiles as Python, else the kind of error and its message."""

    def one(line: str) -> str | None:
        try:
            compile(line or "", "line", "exec")
        except (SyntaxError, ValueError) as e:
            return f"{type(e).__name__}: {e.args[0]}"
        return None

    return lines.map(one)


def compiling(df: DataFrame, column: str) -> DataFrame:
    """Rows whose line compiles."""
    return df.where(compile_error(F.col(column)).isNull())


def rejections(df: DataFrame, column: str) -> DataFrame:
    """How many lines fail, by error."""
    errors = df.select(compile_error(F.col(column)).alias("error")).where(F.col("error").isNotNull())
    return errors.groupBy("error").count().orderBy(F.desc("count"), "error")


def plain_text(html: Column) -> Column:
    """Tags left out and the five entities decoded."""
    out = F.regexp_replace(html, "<[^>]*>", "")
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(ch))
    return out
