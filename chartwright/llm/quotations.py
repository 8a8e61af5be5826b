"""Operator 9: linking quoted passages to their messages, and conversations in reply order without quotes.

A message's lines are parsed by their quote marks ('>', also spaced or nested); runs of lines of one
level, cut at blank lines, are passages. Passages are normalised (marks, case, punctuation and blanks
don't count) and hashed. A message's own passages, those of level 0, are indexed by conversation and
hash; a quoted passage belongs to the earliest message before it with that hash. The message most
quoted at level 1 (most passages, then the latest) is the parent; attribution lines that introduce a
quote go with it. What is left of a message is its level-0 text.

Reply order: a message's depth is its distance to the root of its parents, found by doubling pointers
(as many rounds as the logarithm of the longest chain), and a conversation reads in order of root,
depth and turn. Messages stay rows, keyed by conversation and hash: no task holds a conversation, also
not where turns are written as replies, which is done by ranges of (conversation, turn).

Parsing is done in Arrow batches; joins are on (conversation, hash), and each indexed passage is one
row, the earliest, so a passage that very many messages quote meets one row; the quoting side of such
a passage is spread over SALTS tasks. Chains are written at each round, so their joins are of plain
exchanges, whose skewed partitions (very many replies to one message) adaptive execution splits.

Defined results: a null text has no passages and an empty body; a null conversation or turn is linked
with nothing and is its own root. Rows that repeat conversation and turn are told apart by their
texts, and quotes belong to the one with the smallest hash; equal rows are linked alike. Any other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartwright.llm.common import read, slices, small_batches, staged

SALTS = 16
#: Bytes of texts that are parsed at once.
SLICE = 1 << 20
MARK = re.compile(r"^(?:[ \t]{0,3}>)+[ \t]?")
ATTRIBUTION = re.compile(r"^.{0,200}\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$", re.IGNORECASE)
PARSED = "conv_id long, turn long, message long, body string, passages array<struct<level:int,hash:long>>"


def lines_of(text: str) -> list[tuple[int, str]]:
    """(level, line without marks) of each line; only line feeds end one."""
    out = []
    for line in text.split("\n"):
        m = MARK.match(line)
        out.append((m[0].count(">"), line[m.end() :]) if m else (0, line))
    return out


def normalised(passage: str) -> str:
    return " ".join(re.findall(r"\w+", passage.lower()))


def passages(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text without quotes and their attributions, and (level, hash) of each passage with a word in it."""
    lines = lines_of(text)
    body, found, run, level = [], [], [], 0

    def end() -> None:
        if words := normalised("\n".join(run)):
            found.append((level, xxhash.xxh3_64_intdigest(words) - 2**63))
        run.clear()

    for i, (n, line) in enumerate(lines):
        if n != level or not line.strip():
            end()
            level = n
        if n == 0 and ATTRIBUTION.match(line) and any(m > 0 for m, x in lines[i + 1 : i + 3]):
            continue
        if line.strip():
            run.append(line)
        if n == 0:
            body.append(line)
    end()
    return "\n".join(body).strip(), found


def parsed(messages: DataFrame) -> DataFrame:
    """Rows (PARSED) of messages (conv_id, turn, text); message is a hash of the row."""
    small_batches(messages.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64())]))
        for b in (part for whole in batches for part in slices(whole, "text", SLICE)):
            got = [passages(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("message"), pa.array([x[0] for x in got], pa.string()), pa.array([[{"level": n, "hash": h} for n, h in x[1]] for x in got], kind)], ["conv_id", "turn", "message", "body", "passages"])

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64("conv_id", "turn", "text").alias("message"), "text")
    return rows.mapInArrow(go, PARSED)


def quoted(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, message, level, hash, from_turn, from_message) of each quoted passage that an earlier message of the conversation wrote."""
    each = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", "message", F.explode(F.array_distinct("passages")).alias("p")).select("conv_id", "turn", "message", "p.level", "p.hash")
    own = each.where("level = 0").groupBy("conv_id", "hash").agg(F.min(F.struct("turn", "message")).alias("first"))
    own = own.select("conv_id", "hash", F.col("first.turn").alias("from_turn"), F.col("first.message").alias("from_message"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marks = each.where("level > 0").withColumn("salt", F.pmod("message", F.lit(SALTS)).cast("int"))
    return marks.join(own, ["conv_id", "hash", "salt"]).where("from_turn < turn").drop("salt")


def replies(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, message, parent_turn, parent): each message's parent, for those that have one."""
    votes = quoted(messages).where("level = 1").groupBy("conv_id", "turn", "message", "from_turn", "from_message").agg(F.count("*").alias("n"))
    best = votes.groupBy("conv_id", "turn", "message").agg(F.max(F.struct("n", "from_turn", "from_message")).alias("b"))
    return best.select("conv_id", "turn", "message", F.col("b.from_turn").alias("parent_turn"), F.col("b.from_message").alias("parent"))


def rooted(parents: DataFrame, rounds: int = 40) -> DataFrame:
    """Rows (conv_id, message, root, root_turn, depth) for rows (conv_id, message, parent, parent_turn): the last message of each chain of parents and how far it is."""
    first = parents.select("conv_id", "message", F.col("parent").alias("root"), F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    at = staged(first.dropDuplicates(["conv_id", "message"]), "chains")
    for _ in range(rounds):
        up = at.select("conv_id", F.col("message").alias("root"), F.col("root").alias("further"), F.col("root_turn").alias("further_turn"), F.col("depth").alias("more"))
        found = at.join(up, ["conv_id", "root"], "left")
        after = staged(found.select("conv_id", "message", F.coalesce("further", "root").alias("root"), F.coalesce("further_turn", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")), "chains")
        at = after.drop("moved")
        if after.where("moved").isEmpty():
            return at
    raise RuntimeError(f"chains did not end in {rounds} doublings")


def conversations(messages: DataFrame) -> DataFrame:
    """One row for each message (conv_id, turn, text): conv_id, turn, body, parent_turn, root_turn, depth."""
    made = staged(parsed(messages), "messages")
    parents = staged(replies(made), "parents")
    key = ["conv_id", "message"]
    told = parents.select(*key, "parent_turn").dropDuplicates(key).join(rooted(parents), key)
    rows = made.select("conv_id", "turn", "message", "body").join(told.select(*key, "parent_turn", "root_turn", "depth"), key, "left")
    return rows.select("conv_id", "turn", "body", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def with_previous(turns: DataFrame) -> DataFrame:
    """Adds one and two: the texts of the turn before and of the one before that in the conversation, by turn, then text.

    Rows are dealt to ranges of (conversation, turn), written once; each range is a window of its own,
    and the two last rows of each, so few, are carried over to the next.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "text"]
    ranged = staged(turns.select(*order).repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id()), "ranges")
    it = F.struct("conv_id", "text")
    inside, back = W.partitionBy("pid").orderBy(*order), W.partitionBy("pid").orderBy(*(F.desc(c) for c in order))
    rows = ranged.withColumn("nth", F.row_number().over(inside)).withColumn("p1", F.lag(it, 1).over(inside)).withColumn("p2", F.lag(it, 2).over(inside))
    tails = ranged.withColumn("last", F.row_number().over(back)).where("last <= 2").select("pid", "last", it.alias("it"))
    flow = W.orderBy("pid", F.desc("last"))
    heads = tails.withColumn("b1", F.lag("it", 1).over(flow)).withColumn("b2", F.lag("it", 2).over(flow))
    heads = heads.groupBy("pid").agg(F.max_by(F.struct("b1", "b2"), "last").alias("b"))
    met = rows.join(F.broadcast(heads), "pid")  # a row for each range
    one = F.when(F.col("nth") > 1, F.col("p1")).otherwise(F.col("b.b1"))
    two = F.when(F.col("nth") > 2, F.col("p2")).when(F.col("nth") == 2, F.col("b.b1")).otherwise(F.col("b.b2"))
    own = lambda x: F.when(x["conv_id"].eqNullSafe(F.col("conv_id")), x["text"])
    return met.select(*order, own(one).alias("one"), own(two).alias("two"))


def as_replies(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, text) written as mail: each message quotes the one before it, and at the second level the one before that."""
    quote = lambda text, mark: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)))
    both = F.concat_ws("\n>\n", quote(F.col("two"), ">> "), quote(F.col("one"), "> "))
    written = F.concat(F.lit("They wrote:\n"), both, F.lit("\n\n"), F.col("text"))
    return with_previous(turns).select("conv_id", "turn", F.when(F.col("one").isNotNull(), written).otherwise(F.col("text")).alias("text"))


def op9_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` written as quoting replies, and read back: each message's body without quotes, its parent, root and depth."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    found = conversations(as_replies(turns))
    return found.select("conv_id", "turn", F.sha2("body", 256).alias("body_sha256"), "parent_turn", "root_turn", "depth")


OP9_SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS body,
  array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), ' ') AS words FROM conversations),
f AS (SELECT conv_id, words, min(turn) AS turn FROM t WHERE words <> '' GROUP BY 1, 2),
l AS (SELECT conv_id, turn, body, lag(words) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM t),
p AS MATERIALIZED (SELECT l.conv_id, l.turn, l.body, CASE WHEN f.turn < l.turn THEN f.turn END AS parent_turn FROM l LEFT JOIN f ON f.conv_id = l.conv_id AND f.words = l.q),
r AS (SELECT conv_id, turn, turn AS root_turn, 0 AS depth FROM p WHERE parent_turn IS NULL
  UNION ALL SELECT p.conv_id, p.turn, r.root_turn, r.depth + 1 FROM p JOIN r ON r.conv_id = p.conv_id AND r.turn = p.parent_turn)
SELECT p.conv_id, p.turn, sha256(p.body) AS body_sha256, p.parent_turn, r.root_turn, CAST(r.depth AS BIGINT) AS depth
FROM p JOIN r ON r.conv_id = p.conv_id AND r.turn = p.turn
"""
