"""Operator 2 [native]: secrets by pattern, and by sliding-window Shannon entropy.

Patterns give the base spans. Beside them, each candidate string (a long run of a character class)
is read with a window of fixed width; the window's character counts, and the sum of c log2 c, change
by one character in and one out at each step, so the entropy of every window costs the same. From the
first to the last window at or over the class's threshold, the candidate is a span. Candidates on the
allow-list (identifiers that look random but are public) are no spans.

All is done with DataFrame functions in the task that reads the text; nothing is shuffled.

Defined results: a null text is an empty one and has no spans. Rows that repeat are scanned each. Any
other columns are kept by with_secrets(), which adds secret_base and secret_spans and refuses a table
that has them, and by redacted(), which adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwright.llm import spans as S
from chartwright.llm.common import read

#: The pattern kinds in order, then the entropy classes.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex"]
#: name, candidates, window, least entropy in bits, what a span must hold besides.
CLASSES = [
    ("entropy_hex", r"(?<![A-Za-z0-9])(?:[0-9A-F]{20,}|[0-9a-f]{20,})(?![A-Za-z0-9])", 20, 3.0, r"^(?=.*[0-9])(?=.*[A-Fa-f])"),
    ("entropy_base64", r"[A-Za-z0-9+/_-]{24,}={0,2}", 20, 3.8, r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])"),
]
#: Bits of a character's count in a long, counts in a long, and the greatest count.
COUNT_BITS, PER_LONG, COUNT_MOST = 5, 12, 31
#: Candidates that match one of these are public: UUIDs, digests in subresource-integrity form, documentation keys, alphabets.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^sha(256|384|512)-",
    r"EXAMPLE",
    r"(?i)abcdefghijklmnop|0123456789abcdef",
]


def _xlog(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def hot_range(text: Column, window: int, least: float) -> Column:
    """Struct (first, last) of a string of printable ASCII characters: where the windows of at least that entropy begin and end; nulls if there is none.

    The counts of a window's characters, at most COUNT_MOST each, are packed in longs, so that a step
    changes one field of one or two of them.
    """
    if window > COUNT_MOST:
        raise ValueError(f"a window has at most {COUNT_MOST} characters")
    places = -(-96 // PER_LONG)
    state = F.struct(F.array_repeat(F.lit(0).cast("long"), places).alias("counts"), F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    count = lambda counts, at: F.call_function("shiftright", F.element_at(counts, at["word"] + 1), at["bit"]).bitwiseAND(F.lit(COUNT_MOST))

    def step(acc: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        c_new, c_old = count(acc["counts"], new), F.when(old["word"] >= 0, count(acc["counts"], old)).otherwise(F.lit(0).cast("long"))
        kept = F.transform(acc["counts"], lambda c, j: c + F.when(j == new["word"], one(new["bit"])).otherwise(0) - F.when(j == old["word"], one(old["bit"])).otherwise(0))
        moved = acc["s"] + _xlog(c_new + 1) - _xlog(c_new) + F.when(c_old > 0, _xlog(c_old - 1) - _xlog(c_old)).otherwise(0.0)
        s = F.when((new["word"] == old["word"]) & (new["bit"] == old["bit"]), acc["s"]).otherwise(moved)
        # log2(w) - s / w >= least, as a bound on s
        high = (x["i"] >= window) & (s <= F.lit(window * (_log2(window) - least) + 1e-9))
        return F.struct(kept.alias("counts"), s.alias("s"), F.coalesce(acc["first"], F.when(high, x["i"] - window)).alias("first"), F.when(high, x["i"]).otherwise(acc["last"]).alias("last"))

    def moves(places_: Column) -> Column:
        none = F.array_repeat(F.struct(F.lit(-1).alias("word"), F.lit(0).alias("bit")), window)
        both = F.zip_with(places_, F.slice(F.concat(none, places_), F.lit(1), F.size(places_)), lambda n, o: F.struct(n.alias("new"), o.alias("old")))
        return F.transform(both, lambda x, i: F.struct((i + 1).alias("i"), x["new"].alias("new"), x["old"].alias("old")))

    code = lambda c: F.ascii(c) - 32
    spots = F.transform(F.split(text, "", -1), lambda c: F.struct(F.floor(code(c) / PER_LONG).cast("int").alias("word"), (code(c) % PER_LONG * COUNT_BITS).alias("bit")))
    return F.aggregate(S.let(spots, moves), state, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _log2(x: float) -> float:
    import math

    return math.log2(x)


def entropy_spans(text: Column, at: int, allow: list[str] | None = None) -> Column:
    """Spans of class number `at`, whose kind follows the patterns' kinds."""
    _, pattern, window, least, holds = CLASSES[at]
    kept = F.filter(S.find(text, pattern, len(KINDS) + at), lambda s: s["text"].rlike(holds) & ~s["text"].rlike("|".join(ALLOW if allow is None else allow)))
    cut = F.transform(kept, lambda s: F.struct(s.alias("s"), hot_range(s["text"], window, least).alias("r")))
    return F.transform(
        F.filter(cut, lambda x: x["r"]["first"].isNotNull()),
        lambda x: F.struct((x["s"]["start"] + x["r"]["first"]).alias("start"), (x["s"]["start"] + x["r"]["last"]).alias("end"), x["s"]["kind"].alias("kind"), x["s"]["text"].alias("text")),
    )


def base_spans(text: Column) -> Column:
    """The spans of the three patterns, in order of start and kind."""
    assign = F.filter(S.find(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 12)
    return S.ordered(F.concat(assign, S.find(text, ACCESS, 1), S.find(text, HEX, 2)), "start", "kind")


def with_secrets(docs: DataFrame, column: str = "text", allow: list[str] | None = None) -> DataFrame:
    """Adds secret_base (spans of the patterns) and secret_spans (these and those by entropy), arrays of spans. Columns of these names must not be there."""
    if taken := {"secret_base", "secret_spans"} & set(docs.columns):
        raise ValueError(f"columns {sorted(taken)} would be overwritten")
    text = F.coalesce(F.col(column), F.lit(""))
    found = docs.withColumn("secret_base", base_spans(text))
    return found.withColumn("secret_spans", S.ordered(F.concat("secret_base", *(entropy_spans(text, i, allow) for i in range(len(CLASSES)))), "start", "kind"))


#: A column's name while texts are redacted; no table has it.
_FREE = "\x01spans"


def redacted(docs: DataFrame, column: str = "text") -> DataFrame:
    """The documents with each secret replaced by [SECRET]; texts without one stay as they are."""
    text = F.coalesce(F.col(column), F.lit(""))
    spans = F.concat(base_spans(text), *(entropy_spans(text, i) for i in range(len(CLASSES))))
    own = docs.withColumn(_FREE, spans)
    return own.withColumn(column, S.replaced(F.col(column), F.col(_FREE), lambda s: F.lit("[SECRET]"))).select(*docs.columns)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the secrets in each document."""
    found = with_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [*KINDS, *(c[0] for c in CLASSES)]
    base = F.col("secret_base")
    return found.select("doc_id", *(S.count(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(S.joined(base, names), 256).alias("base_sha256"), S.joined(F.col("secret_spans"), names).alias("spans"))


_FIND = """SELECT doc_id, {kind} AS kind, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS INT) AS start, hits[i] AS hit
 FROM (SELECT doc_id, string_split_regex(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}) AS hits FROM d), unnest(range(1, len(hits) + 1)) AS u(i)"""


def _sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    assign = ASSIGN
    parts = [_FIND.format(kind=i, pattern=quote(p)) for i, p in enumerate((assign, ACCESS, HEX, r"[0-9A-Za-z]{20,}", CLASSES[1][1]))]
    allow = " OR ".join(f"regexp_matches(hit, {quote(a)})" for a in ALLOW)
    names = "['" + "','".join([*KINDS, *(c[0] for c in CLASSES)]) + "']"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
base AS (SELECT doc_id, kind, start, start + length(hit) AS stop FROM f
  WHERE kind IN (1, 2) OR kind = 0 AND length(regexp_extract(hit, {quote(assign)}, 2)) >= 12),
c AS (SELECT row_number() OVER () AS id, doc_id, kind, start, hit FROM f
  WHERE kind >= 3 AND NOT ({allow})
  AND (kind = 3 AND regexp_matches(hit, '[0-9]') AND (regexp_full_match(hit, '[0-9A-F]+') AND regexp_matches(hit, '[A-F]') OR regexp_full_match(hit, '[0-9a-f]+') AND regexp_matches(hit, '[a-f]'))
    OR kind = 4 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]'))),
w AS (SELECT id, doc_id, kind, start, p, substr(hit, CAST(p AS INT), 20) AS win FROM c, unnest(range(1, length(hit) - 20 + 2)) AS u(p)),
k AS (SELECT id, doc_id, kind, start, p, ch, count(*) AS n FROM w, unnest(string_split(win, '')) AS v(ch) GROUP BY ALL),
h AS (SELECT id, doc_id, kind, start, p, sum(n * log2(n)) AS s FROM k GROUP BY ALL),
e AS (SELECT id, doc_id, kind, CAST(start + min(p) - 1 AS INT) AS b, CAST(start + max(p) - 1 + 20 AS INT) AS stop FROM h
  WHERE s <= 20 * (log2(20) - CASE kind WHEN 3 THEN {CLASSES[0][3]} ELSE {CLASSES[1][3]} END) + 1e-9 GROUP BY id, doc_id, kind, start),
a AS (SELECT doc_id, kind, start, stop FROM base UNION ALL SELECT doc_id, kind, b, stop FROM e),
s AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS b,
  string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)
"""


OP2_SQL = _sql()
