"""Runs a function of one sentence over a table of sentences.

Equal sentences are computed once: distinct token arrays are dealt to tasks, each task builds the
grammar's tables once and closes one chart at a time, and the results are written. They meet their
sentences by broadcast while they are few, as where sentences repeat; beyond, by a shuffle on the
tokens, whose skewed partitions adaptive execution splits. Nothing else is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwright.functions.chart import Tables
from chartwright.functions.grammar import Grammar
from chartwright.plans.shared import cut, joined

#: Rows of results that are broadcast.
FEW_RESULTS = 50_000


def distinct_sentences(sentences: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct token arrays of 1 to most tokens, as column tokens."""
    fits = (F.size("tokens") > 0) if most is None else F.size("tokens").between(1, most)
    return sentences.where(fits).groupBy("tokens").agg(F.lit(1).alias("_")).drop("_")


def per_sentence(sentences: DataFrame, grammar: Grammar, fn: Callable[[Tables, list[str]], list[tuple]], schema: str, how: str = "inner", most: int | None = None) -> DataFrame:
    """Adds the columns of schema to each sentence, a row for each row that fn returns. Sentences that are empty or have over most tokens have none."""
    names = [c.split()[0] for c in schema.split(", ")]  # nested types have no blank after a comma

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = Tables(grammar)
        for pdf in batches:
            rows = [(tokens, *r) for tokens in map(list, pdf["tokens"]) for r in fn(tables, tokens)]
            yield pd.DataFrame(rows, columns=["tokens", *names])

    found = cut(distinct_sentences(sentences, most).mapInPandas(go, f"tokens array<string>, {schema}"), "results")
    return joined(sentences, found, "tokens", how, FEW_RESULTS)
