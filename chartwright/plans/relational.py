"""The chart as relations: initialisation, closure, back-pointers and sizes by joins.

For line automata a cell's span is its length, so the closure goes span by span: each step joins the
cells of the shorter spans that add up to it at their common state with the broadcast binary rules (bounded by the
grammar, not the data), and is written as a table of its own before the next. All joins are on (sid, state); a sentence's
cells never leave its keys' partitions except by that exchange. It is the plan for many sentences of
a small grammar, and the reference for the per-sentence kernel, which is the faster one for others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwright.functions.grammar import HOLE, START, Grammar
from chartwright.plans.shared import cut


def line_arcs(sentences: DataFrame) -> DataFrame:
    """Rows (sid, q, q2, kind, tok) for sentences (sid, tokens)."""
    arcs = sentences.select("sid", F.posexplode("tokens").alias("q", "tok"))
    return arcs.select("sid", "q", (F.col("q") + 1).alias("q2"), F.when(F.col("tok") == HOLE, "ANY").otherwise("EQ").alias("kind"), F.when(F.col("tok") != HOLE, F.col("tok")).alias("tok"))


def edit_arcs(sentences: DataFrame, radius: int) -> DataFrame:
    """Rows (sid, i, j, i2, j2, kind, tok): the arcs of all strings within the radius; states are (position, edits)."""
    n = F.size("tokens")
    states = sentences.select("sid", "tokens", F.explode(F.sequence(F.lit(0), n)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("j"))
    here = F.get("tokens", F.col("i"))
    arc = lambda di, dj, kind, tok, when: F.when(when, F.struct((F.col("i") + di).alias("i2"), (F.col("j") + dj).alias("j2"), kind.alias("kind"), tok.alias("tok")))
    ok, room = F.col("i") < n, F.col("j") < radius
    kinds = [arc(0, 1, F.when(ok, "NE").otherwise("ANY"), here, room), arc(1, 0, F.lit("EQ"), here, ok), arc(1, 1, F.lit("NE"), here, ok & room)]
    kinds += [arc(d + 1, d, F.lit("EQ"), F.get("tokens", F.col("i") + d), (F.col("i") + d < n) & (F.col("j") + d <= radius)) for d in range(1, radius + 1)]
    return states.select("sid", "i", "j", F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("a")).select("sid", "i", "j", "a.*")


def leaf_counts(arcs: DataFrame, grammar: Grammar, keys: list[str]) -> DataFrame:
    """Rows (keys, nt, n): how many tokens of each nonterminal satisfy an arc's predicate; only those with some."""
    unit = grammar.frames(arcs.sparkSession)["unit"]
    exact = arcs.where("kind = 'EQ'").join(F.broadcast(unit), "tok").select(*keys, F.col("a").alias("nt"), F.lit(1).alias("n"))
    # any token, or any but one: every nonterminal with tokens, by the size of its list, which the grammar bounds
    by_nt = {list(grammar.nonterminals).index(a): ts for a, ts in grammar.tokens.items()}
    rows = F.array(*(F.struct(F.lit(a).alias("nt"), (F.lit(len(ts)) - F.when((F.col("kind") == "NE") & F.col("tok").isin(ts), 1).otherwise(0)).alias("n")) for a, ts in sorted(by_nt.items())))
    free = arcs.where("kind <> 'EQ'").select(*keys, F.explode(rows).alias("r")).select(*keys, "r.nt", "r.n").where("n > 0")
    return exact.unionByName(free)


def chart(sentences: DataFrame, grammar: Grammar, max_span: int) -> DataFrame:
    """Rows (sid, q, q2, nt, n): the closed chart of sentences (sid, tokens) of at most max_span tokens; n counts derivations, decimal(38,0).

    Each span is a table of its own. A span's cells come from pairs of spans that add up to it, so each
    pair of cells meets once, and only new cells are written.
    """
    spark = sentences.sparkSession
    rules = F.broadcast(grammar.frames(spark)["bin"].select("a", "b", "c"))
    short = sentences.where(F.size("tokens") <= max_span)
    leaves = leaf_counts(line_arcs(short), grammar, ["sid", "q", "q2"])
    cells = cut(leaves.select("sid", "q", "q2", "nt", F.col("n").cast("decimal(38,0)").alias("n")), "chart")
    length = F.col("q2") - F.col("q")
    for span in range(2, max_span + 1):
        # a left part of some length meets right parts of the length that is left
        left = cells.select("sid", F.col("q2").alias("m"), (F.lit(span) - length).alias("rest"), "q", F.col("nt").alias("b"), F.col("n").alias("ln"))
        right = cells.select("sid", F.col("q").alias("m"), length.alias("rest"), "q2", F.col("nt").alias("c"), F.col("n").alias("rn"))
        met = left.join(right, ["sid", "m", "rest"]).join(rules, ["b", "c"])
        new = met.groupBy("sid", "q", "q2", F.col("a").alias("nt")).agg(F.sum((F.col("ln") * F.col("rn")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("n"))
        cells = cells.unionByName(cut(new, "chart"))
    return cells


def merged(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each cell (keys) of rows with has_bin and lit: a cell that is a leaf and has binary derivations too is one cell."""
    return cells.groupBy(*keys).agg(F.max("has_bin").alias("has_bin"), F.max("lit").alias("lit"))


def distributions(cells: DataFrame, grammar: Grammar) -> DataFrame:
    """Rows (sid, q, q2, nt, m, b, c, size, before): the expansions of each cell of a closed chart, with how many derivations each has and all before it have, by (m, b, c)."""
    from pyspark.sql import Window as W

    rules = F.broadcast(grammar.frames(cells.sparkSession)["bin"].select("a", "b", "c"))
    left = cells.select("sid", "q", F.col("q2").alias("m"), F.col("nt").alias("b"), F.col("n").alias("ln"))
    right = cells.select("sid", F.col("q").alias("m"), "q2", F.col("nt").alias("c"), F.col("n").alias("rn"))
    each = left.join(right, ["sid", "m"]).join(rules, ["b", "c"]).select("sid", "q", "q2", F.col("a").alias("nt"), "m", "b", "c", (F.col("ln") * F.col("rn")).cast("decimal(38,0)").alias("size"))
    w = W.partitionBy("sid", "q", "q2", "nt").orderBy("m", "b", "c").rowsBetween(W.unboundedPreceding, -1)
    return each.withColumn("before", F.coalesce(F.sum("size").over(w).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))


def roots(cells: DataFrame, sentences: DataFrame, grammar: Grammar) -> DataFrame:
    """Sentences (sid, tokens) with accepted and n_trees."""
    start = list(grammar.nonterminals).index(START)
    tops = cells.where((F.col("nt") == start) & (F.col("q") == 0)).select("sid", F.col("q2").alias("end"), F.col("n").alias("n_trees"))
    found = sentences.join(tops, (sentences["sid"] == tops["sid"]) & (F.size("tokens") == F.col("end")), "left").drop(tops["sid"]).drop("end")
    return found.withColumn("accepted", F.col("n_trees").isNotNull()).withColumn("n_trees", F.coalesce("n_trees", F.lit(0).cast("decimal(38,0)")))


def back_pointers(cells: DataFrame, grammar: Grammar) -> DataFrame:
    """Rows (sid, q, q2, nt, m, b, c): the steps by which binary rules derive cells of the closed chart."""
    rules = F.broadcast(grammar.frames(cells.sparkSession)["bin"].select("a", "b", "c"))
    left = cells.select("sid", "q", F.col("q2").alias("m"), F.col("nt").alias("b"))
    right = cells.select("sid", F.col("q").alias("m"), "q2", F.col("nt").alias("c"))
    return left.join(right, ["sid", "m"]).join(rules, ["b", "c"]).select("sid", "q", "q2", F.col("a").alias("nt"), "m", "b", "c")


def running(df: DataFrame, keys: list[str], order: list[str], value: str, most: int = 4294967295) -> DataFrame:
    """Adds before: the sum of values ahead in the key's order, 0 at its first row, at most `most`."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("before", F.least(F.coalesce(F.sum(F.col(value).cast("decimal(38,0)")).over(w), F.lit(0)).cast("decimal(38,0)"), F.lit(most).cast("decimal(38,0)")))


def reach(arcs: DataFrame, rounds: int = 30) -> DataFrame:
    """Rows (sid, q, q2): pairs of states with a path, of arcs (sid, q, q2), by doubling until nothing is new."""
    known = cut(arcs.select("sid", "q", "q2").distinct())
    for _ in range(rounds):
        longer = known.join(known.select("sid", F.col("q").alias("q2"), F.col("q2").alias("q3")), ["sid", "q2"]).select("sid", "q", F.col("q3").alias("q2"))
        after = cut(known.unionByName(longer).distinct())
        if after.count() == known.count():
            return after
        known = after
    raise RuntimeError(f"paths of over 2^{rounds} arcs")


def mid_points(pairs: DataFrame) -> DataFrame:
    """Rows (sid, q, q2, m): states between reachable pairs."""
    return pairs.select("sid", "q", F.col("q2").alias("m")).join(pairs.select("sid", F.col("q").alias("m"), "q2"), ["sid", "m"]).select("sid", "q", "q2", "m")


def matrix_square(entries: DataFrame) -> DataFrame:
    """The square of a sparse matrix (r, c, v)."""
    left, right = entries.select("r", F.col("c").alias("k"), F.col("v").alias("x")), entries.select(F.col("r").alias("k"), "c", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("r", "c").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def forward(binary: DataFrame) -> DataFrame:
    """Each nonterminal's binary right sides, as one list."""
    return binary.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "c"))).alias("rhs"))


def left_adjacency(binary: DataFrame) -> DataFrame:
    """For each right side, its parents as words of 32 bits: (b, c, word, mask)."""
    return binary.groupBy("b", "c", F.expr("a div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, a % 32)")).alias("mask"))
