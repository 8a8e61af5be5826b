"""Runs each sentence's scenario and unites the outputs, as an editor would show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwright.functions.grammar import Grammar
from chartwright.operators import parsing, repairing
from chartwright.plans.shared import cut

#: Fixed value: strings of a stub that are looked at.
STUBS = 100


def outputs(sentences: DataFrame, grammar: Grammar, radius: int = 2, buffer: int = 1, k: int = repairing.TOP, suffix: bool = False, names: dict[str, str] | None = None) -> DataFrame:
    """Rows (sid, scenario, rank, output) of sentences (sid, tokens): the strings of a stub, the ways to fill holes, the endings of a prefix (of the whole sentence), one tree of a sentence, or the nearest repairs.

    names: symbols to be written otherwise in outputs, as [START] for START in lines of a grammar.
    A sentence without a result has no row. Each branch reads the same written table.
    """
    known = cut(parsing.scenarios(sentences.select("sid", "tokens"), grammar, suffix), "scenarios")
    of = lambda name: known.where(F.col("scenario") == name).select("sid", "scenario", "tokens")

    def renamed(tokens: Column, old: str, new: str) -> Column:
        return F.transform(tokens, lambda x: F.when(x == old, new).otherwise(x))

    def text(tokens: Column) -> Column:
        for old, new in (names or {}).items():
            tokens = renamed(tokens, old, new)
        return F.array_join(tokens, " ")

    cols = ["sid", "scenario", "rank"]
    branches = [
        repairing.stub_strings(of("STUB"), grammar, STUBS).where(F.col("rank") <= k).select(*cols, text(F.col("string")).alias("output")),
        repairing.completions(of("COMPLETION"), grammar, k).select(*cols, text(F.col("completion")).alias("output")),
        parsing.trees(of("PARSEABLE"), grammar).select("sid", "scenario", F.lit(1).alias("rank"), F.col("tree").alias("output")),
        repairing.repairs(of("REPAIR"), grammar, radius, buffer, k).select(*cols, text(F.col("repair")).alias("output")),
    ]
    if suffix:
        branches.append(repairing.suffixes(of("SUFFIX_COMPLETION"), grammar, k, parsing.SUFFIX).select(*cols, text(F.concat("tokens", "suffix")).alias("output")))
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out
