"""n-gram and automaton costs of token sequences. Costs are integers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartwright.plans.shared import cut

#: Boundary tokens, cost scale, cost of one more edit.
BEGIN, LINE_END, END, SCALE, EDIT = "BOS", "NEWLINE", "EOS", 10_000, 10_000_000
#: n-grams beyond this number are joined by a shuffle.
BROADCAST = 2_000_000


def framed(tokens: Column) -> Column:
    return F.concat(F.array(F.lit(BEGIN), F.lit(LINE_END)), tokens, F.array(F.lit(LINE_END), F.lit(END)))


def windows(tokens: Column, n: int = 4) -> Column:
    """All runs of n tokens; none if there are fewer. The tokens are evaluated once, not for each run."""
    shifted = lambda t: [F.slice(t, F.lit(k + 1), F.greatest(F.size(t) - (n - 1), F.lit(0))) for k in range(n)]
    runs = lambda t: F.transform(F.arrays_zip(*(x.alias(f"t{k}") for k, x in enumerate(shifted(t)))), lambda z: F.array(*(z[f"t{k}"] for k in range(n))))
    return F.element_at(F.transform(F.array(tokens), lambda t: F.when(F.size(t) >= n, runs(t)).otherwise(F.array().cast("array<array<string>>"))), 1)


def ngrams(sentences: DataFrame, n: int = 4) -> DataFrame:
    """Rows (g, n): how often each run of tokens occurs, sentences framed."""
    return sentences.select(F.explode_outer(windows(framed(F.col("tokens")), n)).alias("g")).where(F.col("g").isNotNull()).groupBy("g").agg(F.count("*").alias("n"))


def cost(n: Column, total: Column) -> Column:
    """-ln of a share, in units of 1/SCALE, rounded, at least 0."""
    return F.greatest(F.lit(0), F.floor(-F.log(n / total) * SCALE + 0.5)).cast("long")


def ngram_scores(sentences: DataFrame, grams: DataFrame, keys: list[str], n: int = 4) -> DataFrame:
    """Rows (keys, score): the summed costs of each framed sentence's runs; a run that grams (g, n) lacks costs as much as one seen once."""
    grams = cut(grams)
    size, total = grams.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    side = F.broadcast(grams) if size <= BROADCAST else grams
    runs = sentences.select(*keys, F.explode(windows(framed(F.col("tokens")), n)).alias("g"))
    each = runs.join(side, "g", "left").select(*keys, cost(F.coalesce("n", F.lit(1)).cast("double"), F.lit(float(max(total, 1)))).alias("c"))
    return each.groupBy(*keys).agg(F.sum("c").alias("score"))


def rank_score(dist: Column, score: Column) -> Column:
    """Distance before n-gram cost."""
    return dist.cast("long") * EDIT + score


class Automaton:
    """A weighted deterministic automaton: edges (state, token) -> (state, cost), final costs, and the cost of a token without an edge, which stays."""

    def __init__(self, start: int, start_cost: int, missing: int, edges: dict[tuple[int, str], tuple[int, int]], final: dict[int, int]) -> None:
        self.start, self.start_cost, self.missing, self.edges, self.final = start, start_cost, missing, edges, final

    def score(self, tokens: list[str]) -> int | None:
        """Summed cost, null if the last state isn't final."""
        q, total = self.walk(tokens)
        return total + self.final[q] if q in self.final else None

    def walk(self, tokens: tuple[str, ...] | list[str]) -> tuple[int, int]:
        """State and cost after some tokens."""
        q, total = self.start, self.start_cost
        for t in tokens:
            q, c = self.edges.get((q, t), (q, self.missing))
            total += c
        return q, total

    def state(self, tokens: tuple[str, ...] | list[str]) -> int:
        return self.walk(tokens)[0]

    def cost(self, tokens: tuple[str, ...] | list[str]) -> int:
        return self.walk(tokens)[1]

    def ranked(self, tokens: list[str], dist: int) -> int | None:
        s = self.score(tokens)
        return None if s is None else s + (dist + 1) * EDIT


def automaton_scores(df: DataFrame, automaton: Automaton, tokens: str = "repair", dist: str = "dist") -> DataFrame:
    """Adds score: the automaton's cost plus EDIT for each edit and one; null for no valid path."""

    @F.pandas_udf(T.LongType())
    def score(words: pd.Series, dists: pd.Series) -> pd.Series:
        return pd.Series([automaton.ranked(list(w), int(d)) for w, d in zip(words, dists, strict=True)], dtype="Int64")

    return df.withColumn("score", score(F.col(tokens), F.col(dist)))


def bigram_automaton(sentences: DataFrame, most: int = 1_000_000) -> Automaton:
    """An automaton with a state for each token, from the bigrams of sentences; an edge for each distinct bigram, an error if there are over `most`."""
    rows = ngrams(sentences, 2).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} different bigrams")
    total: dict[str, int] = {}
    for r in rows:
        total[r["g"][0]] = total.get(r["g"][0], 0) + r["n"]
    ids = {t: i for i, t in enumerate(sorted({x for r in rows for x in r["g"]}))}
    edges = {(ids[r["g"][0]], r["g"][1]): (ids[r["g"][1]], round(-math.log(r["n"] / total[r["g"][0]]) * SCALE)) for r in rows}
    return Automaton(ids.get(LINE_END, 0), 0, 20 * SCALE, edges, {i: 0 for i in ids.values()})


def reranked(df: DataFrame, keys: list[str], place: str, model=None, vocabulary: set[str] | None = None, tokens: str = "repair") -> DataFrame:
    """Adds reranked: places by falling score of a model (token lists to numpy scores), ties by place. The old places stay for a key without a model, with one candidate, or with a token outside the vocabulary."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    if model is None:
        return df.withColumn("reranked", F.row_number().over(w.orderBy(place)))

    @F.pandas_udf(T.DoubleType())
    def score(words: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(model([list(x) for x in words]), dtype=float))

    known = F.forall(tokens, lambda t: t.isin(sorted(vocabulary))) if vocabulary is not None else F.lit(True)
    scored = df.withColumn("_s", score(F.col(tokens))).withColumn("_k", F.min(known.cast("int")).over(w))
    return scored.withColumn("reranked", F.row_number().over(w.orderBy(F.when(F.col("_k") == 1, -F.col("_s")), place))).drop("_s", "_k")


def ngram_scorer(grams: DataFrame, n: int = 4, tokens: str = "repair"):
    """A scorer for ranking.searched(): distance before the n-gram cost of the repair, each different one scored once."""

    def scored(found: DataFrame) -> DataFrame:
        plain = found.withColumn("_key", F.to_json(tokens))
        costs = ngram_scores(plain.select("_key", F.col(tokens).alias("tokens")).dropDuplicates(["_key"]), grams, ["_key"], n).withColumnRenamed("score", "_cost")
        return plain.join(costs, "_key").withColumn("score", rank_score(F.col("dist"), F.col("_cost"))).drop("_key", "_cost")

    return scored


class BagModel:
    """Scores token lists by weights as sources.readers.weights() reads them: embedding (tokens x size), output (size), bias (1). A list's score is the mean of its tokens' vectors times the output."""

    def __init__(self, weights: dict[str, np.ndarray], vocabulary: list[str]) -> None:
        self.ids = {t: i for i, t in enumerate(vocabulary)}
        self.embedding, self.output, self.bias = weights["embedding"], weights["output"], float(weights["bias"][0])
        if self.embedding.shape != (len(vocabulary), len(self.output)):
            raise ValueError("the embedding has a row for each token and the output's size")

    def __call__(self, lists: list[list[str]]) -> np.ndarray:
        return np.array([(self.embedding[[self.ids[t] for t in ts]].mean(axis=0) * self.output).sum() + self.bias if ts else self.bias for ts in lists], dtype=float)
