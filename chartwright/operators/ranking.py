"""Ranking, selection and merging of candidate rows; every order is total, so results don't depend on the run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartwright.functions.grammar import EMPTY
from chartwright.functions.text import edit_signature


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark keeps the limit in each task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def unique_top_k(df: DataFrame, keys: list[str], k: int, score: str = "score", repair: str = "repair") -> DataFrame:
    """The k least scores of different repairs, ε left out of account: keys, repair, score, rank."""
    plain = df.where(F.col(score) < 0x7FFFFFFF).withColumn(repair, F.array_remove(repair, EMPTY))
    return top_k(plain.groupBy(*keys, repair).agg(F.min(score).alias(score)), keys, [F.col(score), F.size(repair), F.col(repair)], k)


def distinct_words(df: DataFrame, keys: list[str], repair: str = "repair", dist: str = "dist") -> DataFrame:
    """Each repair once, at its least distance."""
    return df.groupBy(*keys, repair).agg(F.min(dist).alias(dist))


def display_order(repair: str = "repair", dist: str = "dist") -> list[Column]:
    """By distance, then length of the text, then the text."""
    text = F.array_join(repair, " ")
    return [F.col(dist), F.length(text), text]


def one_for_signature(df: DataFrame, keys: list[str], old: str, new: str, order: list[Column]) -> DataFrame:
    """The first row of each abstract edit signature: adds signature."""
    signed = df.withColumn("signature", edit_signature(F.col(old), F.col(new), True))
    return top_k(signed, [*keys, "signature"], order, 1, "_first").drop("_first")


def fair_merge(df: DataFrame, keys: list[str], branch: str, place: str, k: int) -> DataFrame:
    """The first k rows of a round robin over branches: all first ones, then all second ones, and so on."""
    return top_k(df, keys, [F.col(place), F.col(branch)], k, "merged")


def branch_order(df: DataFrame, keys: list[str], exact: Column, suffix: Column, name: Column, k: int = 3) -> DataFrame:
    """Branches that equal what is typed first, then by shortest suffix and name."""
    return top_k(df, keys, [exact.desc(), suffix, name], k)


def expansions(productions: DataFrame, stub: str, k: int = 50) -> DataFrame:
    """Right sides of a stub's nonterminal, other stubs first, then those of fewest symbols."""
    text = F.array_join("rhs", " ")
    of = productions.where(F.col("lhs") == stub.strip("<>"))
    return of.select(text.alias("expansion")).distinct().orderBy(~F.col("expansion").rlike(r"^<\S+>$"), F.length(F.regexp_replace("expansion", "[^ ]", "")), "expansion").limit(k)


def cleaned_completions(df: DataFrame, keys: list[str], text: str, place: str, k: int = 10, first: int = 50) -> DataFrame:
    """Of the first completions by place, those without a trailing NEWLINE or blanks, distinct, the first k."""
    some = top_k(df, keys, [F.col(place), F.col(text)], first, "_at").drop("_at")
    plain = some.withColumn(text, F.trim(F.regexp_replace(text, r"\s*NEWLINE\s*$", ""))).where(F.col(text) != "")
    return top_k(plain.groupBy(*keys, text).agg(F.min(place).alias(place)), keys, [F.col(place)], k)


def invariant(df: DataFrame, unit: DataFrame, symbol: str, token: str) -> DataFrame:
    """Rows whose token may stand for the nonterminal: a substitution that keeps what derives it. unit: rows (sym, tok)."""
    known = F.broadcast(unit.select(F.col("sym").alias(symbol), F.col("tok").alias(token)).distinct())  # a grammar's unit rules
    return df.join(known, [symbol, token], "left_semi")


def searched(found: DataFrame, keys: list[str], k: int, scorer: Callable[[DataFrame], DataFrame] | None = None, metric: list[Column] | None = None, model: Callable | None = None, vocabulary: set[str] | None = None) -> DataFrame:
    """The k best of repairs (keys, dist, repair), ranked by metric, or by the score that scorer adds, or by distance; a model, if any, ranks these k anew.

    Ties go by distance, length and tokens. Adds rank, and reranked with a model.
    """
    from chartwright.operators.scoring import reranked

    scored = scorer(found) if scorer else found
    order = metric or ([F.col("score")] if scorer else [])
    best = top_k(scored, keys, [*order, F.col("dist"), F.size("repair"), F.col("repair")], k)
    return reranked(best, keys, "rank", model, vocabulary) if model else best
