"""Operator 8 [native]: information-theoretic sanitisation of personal data.

Personal data found by pattern (e-mail and IP addresses, card and phone numbers) are the protected
entities. A term in a document that holds an entity discloses it as far as the corpus ties the two
together: with n documents, n_e of them holding the entity, n_t the term, and n_et both, their
pointwise mutual information log2(n n_et / (n_e n_t)) is compared with the entity's own information
content log2(n / n_e). A term whose share of it reaches the threshold is sanitised wherever it stands
in the documents that hold that entity: generalised if the caller names a more general term, else
removed. An entity that all documents hold has no information to disclose. Words that overlap an
entity are removed with it and are no terms.

Counts are of whole documents, over all of them, with partial sums before each shuffle. An entity of a
single document needs no pairs, as it and any term of that document meet once; other entities are
paired with those of a document's terms that are in no more documents than the threshold allows. Joins
take what is in at least 1 of FREQUENT documents (so few terms, entities or pairs) by broadcast and the
rest by shuffle, where no key has many rows.

Defined results: a null text is an empty one. Rows are documents: those that repeat id and text count
each, and get the same spans. Any other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwright.llm import spans as S
from chartwright.llm.common import read, staged, tiered

KINDS = ["email", "ip", "card", "phone"]
#: Java patterns with the matches of the base patterns; possessive, and begun only where a run begins or a match has ended, so that long runs take linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Each of four parts at most 255.
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

#: Least share of an entity's information.
SHARE, FREQUENT = 0.9, 1000
TERM = r"[\p{L}\p{N}]{3,}"
#: A term that touches no entity, where those are replaced by the mark.
MARK = "\x01"
APART = r"(?<![\p{L}\p{N}\x01])[\p{L}\p{N}]{3,}+(?!\x01)"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    ds = F.transform(F.split(F.reverse(digits), "", -1), lambda c: F.ascii(c) - 48)

    def value(d: Column, i: Column) -> Column:
        twice = d * 2
        return F.when(d < 0, 0).when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(ds, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """The spans of the four patterns, in order of kind and start."""
    digits = lambda s: F.regexp_replace(s["text"], "[^0-9]", "")
    ip = F.filter(S.find(text, IP, 1), lambda s: s["text"].rlike(OCTETS))
    card = F.filter(S.find(text, CARD, 2), lambda s: F.length(digits(s)).between(16, 19))
    card = F.filter(card, lambda s: luhn(digits(s)))
    phone = F.filter(S.find(text, PHONE, 3), lambda s: F.length(digits(s)).between(8, 15))
    return S.ordered(F.concat(S.find(text, EMAIL, 0), ip, card, phone), "kind", "start")


def entity(span: Column) -> Column:
    """What a span stands for: its kind and its address in lower case, or its digits."""
    value = F.when(span["kind"] <= 1, F.lower(span["text"])).otherwise(F.regexp_replace(span["text"], "[^0-9]", ""))
    return F.concat_ws(":", span["kind"].cast("string"), value)


def terms(text: Column, pattern: str = TERM) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.lower(w)))


def masked(text: Column, base: Column) -> Column:
    """The text with every character of the spans replaced by the mark; positions stay."""
    mark = lambda s: F.repeat(F.lit(MARK), s["end"] - s["start"])
    tail = lambda s, at: F.repeat(F.lit(MARK), F.greatest(s["end"] - at, F.lit(0)))
    return S.replaced(F.translate(text, MARK, " "), base, mark, tail)


def terms_apart(text: Column, base: Column) -> Column:
    """The distinct terms that overlap no span of base."""
    return terms(masked(text, base), APART)


def spots(text: Column, base: Column, told: Column) -> Column:
    """Spans (kind 4) of the terms in the array told wherever they stand, unless they overlap one of base."""
    lowered = F.transform(S.find(masked(text, base), APART, 4), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lower(s["text"]).alias("text")))
    return F.filter(lowered, lambda s: F.array_contains(told, s["text"]))


def disclosures(held: DataFrame, docs: DataFrame, share: float = SHARE) -> DataFrame:
    """Rows (row, term): the terms that disclose an entity of the row. held: rows (row, entities, terms); docs: rows with text, all of the corpus."""
    n = docs.count()
    often = n / FREQUENT
    own = F.log2(F.lit(float(n)) / F.col("n_e"))
    mutual = lambda n_et: F.log2(F.lit(float(n)) * n_et / (F.col("n_e") * F.greatest(F.col("n_t"), n_et).cast("double")))
    # the share is reached while n_t <= n_et (n / n_e)^(1 - share), and n_et is at most n_e
    most = F.col("n_e") * F.pow(F.lit(float(n)) / F.col("n_e"), F.lit(1 - share)) * (1 + 1e-9)
    each = held.select("row", F.explode("entities").alias("entity"))
    entities = staged(each.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") < n), "entities")
    n_t = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    n_t = staged(n_t.where(F.col("n_t") <= F.lit(entities.agg(F.max(most)).first()[0] or 0.0)), "terms")
    by_row = staged(tiered(each, entities, "entity", F.col("n_e") >= often), "by_row")
    known = staged(tiered(held.select("row", F.explode("terms").alias("term")), n_t, "term", F.col("n_t") >= often), "known")
    # an entity of one row needs no pairs: n_et is 1
    alone = by_row.where("n_e = 1").select("row", "n_e").distinct().join(known, "row").where(mutual(F.lit(1)) >= own * share - 1e-9)
    both = staged(by_row.where("n_e > 1").join(known, "row").where(F.col("n_t") <= most), "both")
    pairs = staged(both.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.max("n_t").alias("n_t"), F.max("n_e").alias("n_e")).where(mutual(F.col("n_et")) >= own * share - 1e-9).select("entity", "term", "n_et"), "pairs")
    told = tiered(both.select("row", "entity", "term"), pairs, ["entity", "term"], F.col("n_et") >= often)
    return alone.select("row", "term").unionByName(told.select("row", "term"))


def sanitised(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """For rows (doc_id, text): doc_id, the text's hash h, base (spans of the patterns) and added (spans of disclosing terms, kind 4)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("text")).withColumn("base", base_spans(F.col("text")))
    found = staged(found.select("row", "doc_id", "h", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "found")
    some, none = found.where(F.col("text").isNotNull()), F.lit([]).cast(f"array<{S.SPAN}>")
    held = some.select("row", F.array_distinct(F.transform("base", entity)).alias("entities"), terms_apart(F.col("text"), F.col("base")).alias("terms"))
    told = disclosures(staged(held, "held"), docs, share).groupBy("row").agg(F.collect_set("term").alias("told"))
    added = F.when(F.col("told").isNotNull(), spots(F.col("text"), F.col("base"), F.col("told")))
    joined = some.join(told, "row", "left").select("doc_id", "h", "base", F.coalesce(added, none).alias("added"))
    return joined.unionByName(found.where(F.col("text").isNull()).select("doc_id", "h", "base", none.alias("added")))


def clean_text(text: Column, spans: Column, general: dict[str, str] | None = None) -> Column:
    """The text with entities replaced by their kind and disclosing terms by a more general one, or removed."""
    known = F.create_map(*(F.lit(x) for kv in (general or {"": ""}).items() for x in kv))
    mark = S.by_kind([*(f"[{k.upper()}]" for k in KINDS), ""])
    return S.replaced(text, spans, lambda s: F.when(s["kind"] < len(KINDS), mark(s)).otherwise(F.coalesce(F.try_element_at(known, s["text"]), F.lit(""))))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the personal data and disclosing terms in each document."""
    found = sanitised(read(spark, sf_dir, "documents"))
    names = [*KINDS, "term"]
    base = F.col("base")
    everything = S.ordered(F.concat("base", "added"), "kind", "start")
    return found.select("doc_id", *(S.count(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(S.joined(base, names), 256).alias("base_sha256"), S.joined(everything, names).alias("spans"))


def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8_pii that SQL can express: counts and digest of the personal data by pattern."""
    found = read(spark, sf_dir, "documents").select("doc_id", base_spans(F.coalesce("text", F.lit(""))).alias("base"))
    base = F.col("base")
    return found.select("doc_id", *(S.count(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(S.joined(base, KINDS), 256).alias("base_sha256"))


_FIND = """SELECT doc_id, {kind} AS kind, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS INT) AS start, hits[i] AS hit
 FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits FROM d), unnest(range(1, len(hits) + 1)) AS u(i)"""
_PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
PII_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS MATERIALIZED ({" UNION ALL ".join(_FIND.format(kind=i, pattern=p) for i, p in enumerate(_PATTERNS))}),
g AS (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS ds FROM f),
k AS (SELECT doc_id, kind, start, start + length(hit) AS stop FROM g WHERE kind = 0
  OR kind = 1 AND len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 3) AS INT) > 255)) = 0
  OR kind = 2 AND length(ds) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(ds) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(ds[-i] AS INT) WHEN CAST(ds[-i] AS INT) > 4 THEN 2 * CAST(ds[-i] AS INT) - 9 ELSE 2 * CAST(ds[-i] AS INT) END)) % 10 = 0
  OR kind = 3 AND length(ds) BETWEEN 8 AND 15),
s AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(KINDS))}, string_agg({KINDS}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY kind, start) AS b FROM k GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(b, '')) AS base_sha256 FROM d LEFT JOIN s USING (doc_id)
"""
