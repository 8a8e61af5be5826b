"""Repair of lines of Python: lexed, repaired by token classes, ranked, put back on the source, and compiled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwright.functions import text as X
from chartwright.functions.grammar import Grammar
from chartwright.operators import ranking, repairing, scoring
from chartwright.plans.shared import cut

#: Weight of an edit and of a unit of n-gram cost in a line's rank.
EDIT, COST = 10_000, 1_000


def rank(dist: Column, score: Column) -> Column:
    """Distance and n-gram cost (in units of 1 / scoring.SCALE) as one number."""
    return dist.cast("long") * EDIT + F.floor(score / F.lit(scoring.SCALE) * COST).cast("long")


def repaired_lines(lines: DataFrame, grammar: Grammar, grams: DataFrame, radius: int = 2, buffer: int = 1, k: int = 10, candidates: int = 100, only_compiling: bool = True) -> DataFrame:
    """Rows (line_id, rank, dist, score, fixed) of lines (line_id, line): the k best repairs of each.

    grammar: of token classes (X.lexed), lines ending in NEWLINE; grams: rows (g, n) of runs of four
    classes. Of each line `candidates` repairs are scored; equal fixed lines are given once, at their
    best rank. With only_compiling those that Python rejects are left out.
    """
    classes = lines.select("line_id", "line", X.lex_classes(F.coalesce("line", F.lit(""))).alias("tokens"))
    found = cut(repairing.repairs(classes, grammar, radius, buffer, candidates).select("line_id", "line", "dist", "repair"), "repairs")
    plain = F.filter("repair", lambda t: t != scoring.LINE_END)  # the frame has its own line end
    distinct = found.select(plain.alias("tokens")).distinct()
    scores = cut(scoring.ngram_scores(distinct.withColumn("key", F.array_join("tokens", " ")), grams, ["key"]), "scores")
    ranked = found.withColumn("key", F.array_join(plain, " ")).join(scores, "key").withColumn("score", rank(F.col("dist"), F.col("score")))
    fixed = ranked.select("line_id", "dist", "score", X.restitch("line", "repair").alias("fixed"))
    if only_compiling:
        fixed = fixed.where(X.compile_error(X.compilable(F.col("fixed"))).isNull())
    best = fixed.groupBy("line_id", "fixed").agg(F.min(F.struct("score", "dist")).alias("b")).select("line_id", "fixed", "b.dist", "b.score")
    return ranking.top_k(best, ["line_id"], [F.col("score"), F.length("fixed"), F.col("fixed")], k).select("line_id", "rank", "dist", "score", "fixed")
