"""Operator 5 [native]: homomorphic multiset hash of a text's paragraphs.

A paragraph hashes to a wide vector of bits; a text's fingerprint is the sum of its paragraphs'
vectors, three 20-bit lanes to a long, modulo 2^60 for each long. Sums don't depend on the order of
the paragraphs, equal multisets have equal sums, and paragraphs are inserted or deleted by adding or
subtracting their vectors (add_fingerprints, subtract_fingerprints), without the rest of the text.

Each bit, read as +1 or -1, makes a lane a random projection of the multiset, so the mean square of
two fingerprints' lane differences estimates how many paragraphs differ: likeness() is one minus that
over the number of paragraphs of both.

Paragraphs are lines; a line of several sentences counts as a paragraph for each, so that texts of one
line can be compared too. All is done with DataFrame functions: paragraphs are exploded and summed in
the task that reads them, and one row for each text is shuffled.

Defined results: a null text is an empty one, whose fingerprint is zero; two empty texts have likeness
1. Rows that repeat both id and text are one document and give as many equal rows. Documents with the
same id are ordered by a hash of their texts; a null id comes first. Any other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartwright.llm.common import read, staged

#: Hash words for a paragraph, of 60 bits each; every SHIFTS-th bit is a lane of the same long.
WORDS, SHIFTS, LANE = 2, 20, 20
WIDTH = WORDS * SHIFTS
LANES = 3 * WIDTH
LOW = (1 << LANE) - 1
#: The lowest bit of each of a long's three lanes.
ONES = 1 | 1 << LANE | 1 << 2 * LANE
MODULUS = (1 << 3 * LANE) - 1
PARAGRAPHS = r"(?<=[.!?])[\x20\t]+|[\r\n]+"


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, without empty ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPHS, -1), lambda p: p != "")


def _hashes(paras: Column, word: int) -> Column:
    return F.transform(paras, lambda p: F.xxhash64(F.lit(word), p))


def _lane_sum(hashes: Column, k: int) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(ONES)), lambda a: a.bitwiseAND(F.lit(MODULUS)))


def add_fingerprints(a: Column, b: Column) -> Column:
    """Fingerprint of two texts' paragraphs together: arrays of WIDTH sums and, last, the number of paragraphs."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MODULUS)))


def subtract_fingerprints(a: Column, b: Column) -> Column:
    """Fingerprint of what is left of a when b's paragraphs are deleted."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MODULUS)))


def to_text(fingerprint: Column) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.hex(x)), "."))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one minus the estimated number of differing paragraphs over the number in both; 1 for equal fingerprints."""
    n = F.element_at(a, -1) - F.element_at(b, -1)

    def square(p: Column, q: Column, at: int) -> Column:
        d = F.lit(2) * (F.shiftright(p, at).bitwiseAND(F.lit(LOW)) - F.shiftright(q, at).bitwiseAND(F.lit(LOW))) - n
        return (d * d).cast("double")

    pairs = F.zip_with(F.slice(a, 1, WIDTH), F.slice(b, 1, WIDTH), lambda p, q: square(p, q, 0) + square(p, q, LANE) + square(p, q, 2 * LANE))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    both = (F.element_at(a, -1) + F.element_at(b, -1)).cast("double")
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - total / F.lit(float(LANES)) / F.greatest(both, F.lit(1.0)))))


def with_fingerprints(texts: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces text columns by their fingerprints, named <column>_sums. The steps are columns of their own, so that each text is split and each paragraph hashed once."""
    keys = [c for c in texts.columns if c not in columns]
    split = texts.select(*keys, *(paragraphs(F.col(c)).alias(c) for c in columns))
    hashed = split.select(*keys, *(F.size(c).cast("long").alias(f"{c}_n") for c in columns), *(_hashes(F.col(c), w).alias(f"{c}_{w}") for c in columns for w in range(WORDS)))
    return hashed.select(*keys, *(F.array(*(_lane_sum(F.col(f"{c}_{w}"), k) for w in range(WORDS) for k in range(SHIFTS)), F.col(f"{c}_n")).alias(f"{c}_sums") for c in columns))


def neighbours(keys: DataFrame, order: list[str], carry: list[str]) -> DataFrame:
    """For distinct rows: the carried columns of the next and the previous row in order (next_..., prev_...), in a ring.

    Rows are dealt to ranges; the ranges, written once so that they can't differ between uses, are
    windows of their own, and only each range's ends meet in one task: as many rows as ranges.
    """
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(keys.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id()), "ranges")
    w = W.partitionBy("pid").orderBy(*order)
    it = F.struct(*carry)
    rows = ranged.withColumn("nx", F.lead(it).over(w)).withColumn("pv", F.lag(it).over(w))
    ends = ranged.groupBy("pid").agg(F.min_by(it, F.struct(*order)).alias("head"), F.max_by(it, F.struct(*order)).alias("tail"))
    ring = W.orderBy("pid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    flow = W.orderBy("pid")
    ends = ends.select("pid", F.coalesce(F.lead("head").over(flow), F.first("head").over(ring)).alias("after"), F.coalesce(F.lag("tail").over(flow), F.last("tail").over(ring)).alias("before"))
    joined = rows.join(F.broadcast(ends), "pid")  # a row for each range
    nx, pv = F.coalesce("nx", "after"), F.coalesce("pv", "before")
    return joined.select(*keys.columns, *(nx[c].alias(f"next_{c}") for c in carry), *(pv[c].alias(f"prev_{c}") for c in carry))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, whose last quarter is the next document's beginning."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", text.alias("text")).withColumn("h", F.xxhash64("text"))
    ids = docs.select("doc_id", "h", F.length("text").cast("long").alias("n_chars")).distinct()
    links = neighbours(ids, ["doc_id", "h"], ["doc_id", "h", "n_chars"])
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])
    d, li = docs.alias("d"), links.alias("l")
    linked = d.join(li, same(docs, links)).select("d.doc_id", "d.h", "d.text", "l.n_chars", "l.next_doc_id", "l.next_h", "l.prev_doc_id", "l.prev_h", F.expr("l.prev_n_chars div 4").alias("take"))
    donors = linked.select(F.col("prev_doc_id").alias("to_doc_id"), F.col("prev_h").alias("to_h"), F.expr("substring(text, 1, cast(take as int))").alias("donor")).dropDuplicates(["to_doc_id", "to_h"])
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))"), F.col("donor"))
    both = linked.join(donors, linked["doc_id"].eqNullSafe(donors["to_doc_id"]) & (linked["h"] == donors["to_h"])).select("doc_id", "h", "n_chars", "next_doc_id", "next_h", "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    prints = staged(with_fingerprints(both, ["text", "edited"]), "fingerprints")
    after = prints.select(F.col("doc_id").alias("at_doc_id"), F.col("h").alias("at_h"), F.col("text_sums").alias("next_sums")).dropDuplicates(["at_doc_id", "at_h"])
    found = prints.join(after, prints["next_doc_id"].eqNullSafe(after["at_doc_id"]) & (prints["next_h"] == after["at_h"]))
    return found.select("doc_id", "n_chars", "edited_sha256", to_text(F.col("text_sums")).alias("fingerprint"), to_text(F.col("edited_sums")).alias("edited_fingerprint"), likeness(F.col("text_sums"), F.col("edited_sums")).alias("near_edited"), likeness(F.col("text_sums"), F.col("next_sums")).alias("near_next"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5_fingerprints that SQL can express: lengths and the edited texts' hashes."""
    return op5_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS k, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS x FROM d)
SELECT doc_id, k AS n_chars, sha256(left(t, k - k // 4) || left(x, k // 4)) AS edited_sha256 FROM n
"""
