"""Spans of regular-expression matches in whole texts, with DataFrame functions only.

A span is a struct (start, end, kind, text): code points, end exclusive. Matches are leftmost and
don't overlap. Spark has no function for their positions, so a text is also split at the matches:
the lengths of the pieces between and of the matches add up to the positions. Arrays that grow by one
element at a time would be copied each time, so running values are made in chunks, and texts are cut
to chunks before pieces are taken from them: the work stays near to linear in matches and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,kind:int,text:string>"
#: Values of a chunk of running(); code points of a chunk of text.
CHUNK, TEXT_CHUNK = 64, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once; inside a lambda an expression would be, for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """op of the integers of an array up to each of them."""
    scan = lambda part, first: F.aggregate(part, F.array(first), lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x)))

    def whole(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))

        def parts(cs: Column) -> Column:
            firsts = scan(F.transform(cs, lambda c: F.aggregate(c, F.lit(zero), op)), F.lit(zero))
            return F.flatten(F.zip_with(cs, F.slice(firsts, F.lit(1), F.size(cs)), lambda c, f: F.slice(scan(c, f), F.lit(2), F.size(c))))

        return F.when(F.size(v) > 0, let(chunks, parts)).otherwise(F.lit([]).cast("array<int>"))

    return let(values, whole)


def find(text: Column, pattern: str, kind: int) -> Column:
    """Array of spans of all matches, in order. The pattern is Java's; it may not match the empty string. A null text has none."""

    def spans(hits: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
        made = F.zip_with(hits, running(lengths, lambda a, x: a + x), lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), h.alias("text")))
        return F.when(F.size(hits) > 0, made).otherwise(F.lit([]).cast(f"array<{SPAN}>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def ordered(spans: Column, first: str, second: str) -> Column:
    """The spans by two of their fields, then by their ends."""
    return F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s[first].alias("a"), s[second].alias("b"), s["end"].alias("end"), s.alias("s")))),
        lambda x: x["s"],
    )


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    known = F.array(*(F.lit(n) for n in names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(known, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def piece(chunks: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text in chunks."""
    of = lambda k: F.substring(F.get(chunks, k), F.greatest(a - k * TEXT_CHUNK, F.lit(0)) + 1, F.least(b - k * TEXT_CHUNK, F.lit(TEXT_CHUNK)) - F.greatest(a - k * TEXT_CHUNK, F.lit(0)))
    numbers = F.sequence(F.floor(a / TEXT_CHUNK).cast("int"), F.floor((b - 1) / TEXT_CHUNK).cast("int"))
    return F.when(b > a, F.array_join(F.transform(numbers, of), "")).otherwise(F.lit(""))


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column], tail: Callable[[Column, Column], Column] | None = None) -> Column:
    """The text with each span replaced by its mark. Of a span that begins inside earlier ones what is beyond their end is replaced by tail of the span and that end, else by nothing."""

    def cut(chunks: Column, sorted_: Column, ends: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        more = (lambda s, at: tail(s, at)) if tail else (lambda s, at: F.lit(""))
        out = F.zip_with(sorted_, before, lambda s, at: F.when(s["start"] >= at, F.concat(piece(chunks, at, s["start"]), mark(s))).otherwise(more(s, at)))
        return F.concat(F.array_join(out, ""), piece(chunks, F.element_at(ends, -1), F.length(text)))

    def begin(sorted_: Column) -> Column:
        ends = running(F.transform(sorted_, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_CHUNK}}}"), F.lit(0)), lambda chunks: let(ends, lambda e: cut(chunks, sorted_, e)))

    return F.when(F.size(spans) > 0, let(ordered(spans, "start", "kind"), begin)).otherwise(text)


def by_kind(marks: list[str]) -> Callable[[Column], Column]:
    """A mark for each kind."""
    known = F.array(*(F.lit(m) for m in marks))
    return lambda s: F.element_at(known, s["kind"] + 1)
