"""Operator 7 [native]: benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are sets of hashed word shingles (words are runs of letters and digits in lower
case). An item of m shingles leaks into a document that holds at least CONTAINMENT of them, however
long the document is. Items are partitioned by size, and in each partition an item is represented by
its k smallest hashes, k = m - ceil(CONTAINMENT * m) + 1 for the partition's largest m: a document
that holds enough of the item misses fewer than k of its shingles, so it holds one of the k. The
search for candidates thus loses none. Each candidate is verified by its exact number of shared
shingles.

Documents' shingles are exploded in the task that reads them and meet the items' signature there, by
broadcast, while that has fewer than SIGNATURE_BROADCAST rows; beyond that by a shuffled join, salted,
so that a shingle which a third of all documents hold is spread over SALTS tasks. Only candidates,
distinct pairs, are shuffled further: as many rows as pairs that are verified. Their documents are
picked by (id, text hash) before their shingles are made again.

Items of fewer words than a shingle's are one shingle of all their words, searched among the
documents' shingles of that length. Items and texts without words match nothing; null texts are
empty. Rows that repeat an id are told apart by their texts. Any other columns are kept by
decontaminated() and ignored by leaks().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwright.llm.common import BROADCAST, read, staged

WORDS, CONTAINMENT = 5, 0.8
#: Item sizes from 2^p to 2^(p+1) - 1 shingles are a partition.
SIGNATURE_BROADCAST = 1_000_000
SALTS = 32


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def shingles_of(words: Column, n: int) -> Column:
    """Distinct hashes of the runs of n words; none if there are fewer."""
    hashed = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.lit(n), *(F.element_at(words, i + k) for k in range(n))))
    return F.when(F.size(words) >= n, F.array_distinct(hashed)).otherwise(F.lit([]).cast("array<long>"))


def item_shingles(items: DataFrame, n: int = WORDS) -> DataFrame:
    """Rows (item_id, n_words, m, hashes): distinct hashes in rising order; n_words is a shingle's length for this item."""
    split = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    short = [F.when(F.size("w") == k, shingles_of(F.col("w"), k)) for k in range(1, n)]
    hashes = F.coalesce(*short, shingles_of(F.col("w"), n)) if short else shingles_of(F.col("w"), n)
    return split.select("item_id", F.least(F.size("w"), F.lit(n)).alias("n_words"), F.array_sort(hashes).alias("hashes")).withColumn("m", F.size("hashes")).distinct()


def signature(shingled: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Rows (n_words, sh, item_id, m): each item's smallest hashes, as many as its size partition needs."""
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.col("m").cast("double"))) + 1) - 1
    # m - ceil(c m) grows with m, so the partition's largest size gives enough for all of it
    k = (top - F.ceil(top * containment - 1e-9) + 1).cast("int")
    return shingled.select("item_id", "m", "n_words", F.explode(F.slice("hashes", F.lit(1), k)).alias("sh"))


def leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, n: int = WORDS) -> DataFrame:
    """Rows (doc_id, h, item_id, m, shared) of documents that hold at least that share of an item's shingles; h is the text's hash.

    docs: rows with doc_id and text; items: rows with item_id and text.
    """
    shingled = staged(item_shingles(items, n), "items")
    signed = staged(signature(shingled, containment), "signature")
    sizes = [r[0] for r in shingled.select("n_words").distinct().collect()]  # n values at most
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).where(F.col("text").isNotNull())

    def sets(rows: DataFrame) -> DataFrame:
        """Rows (doc_id, h, s): the distinct hashes of a text's shingles of all the lengths that items have."""
        split = rows.select("doc_id", "h", words_of(F.col("text")).alias("w"))
        return split.select("doc_id", "h", F.array_distinct(F.concat(F.lit([]).cast("array<long>"), *(shingles_of(F.col("w"), k) for k in sizes))).alias("s"))

    # explode() would add a filter on the array's size, for which Spark makes the words anew for each shingle
    probes = sets(texts).select("doc_id", "h", F.explode_outer("s").alias("sh")).where(F.col("sh").isNotNull())
    marks = signed.select("sh", "item_id")
    if signed.count() <= SIGNATURE_BROADCAST:
        met = probes.join(F.broadcast(marks), "sh")
    else:
        salted = marks.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = probes.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["sh", "salt"])
    candidates = staged(met.select("doc_id", "h", "item_id").distinct(), "candidates")
    # the candidates' documents are few: their sets are made again rather than all sets be kept
    wanted = staged(candidates.select(F.col("doc_id").alias("c_doc"), F.col("h").alias("c_h")).distinct(), "wanted")
    few = wanted.count() <= BROADCAST
    again = sets(texts.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("h") == F.col("c_h")), "left_semi"))
    # an item that a large part of all documents holds: its set is broadcast, or spread over salts
    if (shingled.agg(F.sum("m")).first()[0] or 0) <= SIGNATURE_BROADCAST:
        full = candidates.join(F.broadcast(shingled), "item_id")
    else:
        spread = shingled.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        full = candidates.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(spread, ["item_id", "salt"])
    a, b = full.select("doc_id", "h", "item_id", "m", "hashes").alias("a"), again.dropDuplicates(["doc_id", "h"]).alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")))
    shared = F.size(F.array_intersect("a.hashes", "b.s"))
    return both.select("a.doc_id", "a.h", "a.item_id", "a.m", shared.alias("shared")).where(F.col("shared") >= F.col("m") * containment - 1e-9)


def decontaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents without those into which an item leaks; all their columns."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names that no column of a leak has
    of = dict(zip(docs.columns, plain.columns, strict=True))
    found = staged(leaks(docs, items, containment).select(F.col("doc_id").alias("leak_doc"), F.col("h").alias("leak_h")).distinct(), "leaks")
    found = F.broadcast(found) if found.count() <= BROADCAST else found
    left = plain.join(found, F.col(of["doc_id"]).eqNullSafe(F.col("leak_doc")) & (F.xxhash64(of["text"]) == F.col("leak_h")), "left_anti")
    return left.select(*(F.col(of[c]).alias(c) for c in docs.columns))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that it holds: doc_id, item_id, the item's number of shingles, how many the document has, and their ratio."""
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("m").cast("long").alias("item_shingles"), F.col("shared").cast("long").alias("shared_shingles"), F.round(F.col("shared") / F.col("m"), 6).alias("containment"))


_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
ish AS (SELECT item_id, unnest({_SHINGLES}) AS s FROM i),
m AS (SELECT item_id, count(*) AS item_shingles FROM ish GROUP BY 1),
dsh AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM d WHERE len(w) >= 5),
few AS (SELECT item_id, len(w) AS k, array_to_string(w, ' ') AS s FROM i WHERE len(w) BETWEEN 1 AND 4),
fsh AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda j: array_to_string(w[j:CAST(j + k - 1 AS BIGINT)], ' '))) AS s FROM d, (SELECT DISTINCT k FROM few) WHERE len(w) >= k),
x AS (SELECT doc_id, item_id, count(*) AS shared_shingles FROM dsh JOIN (SELECT * FROM ish WHERE item_id NOT IN (SELECT item_id FROM few)) USING (s) GROUP BY 1, 2
  UNION ALL SELECT doc_id, item_id, 1 FROM fsh JOIN few USING (k, s))
SELECT doc_id, item_id, item_shingles, shared_shingles, round(shared_shingles / item_shingles, 6) AS containment
FROM x JOIN m USING (item_id) WHERE shared_shingles >= 0.8 * item_shingles
"""
