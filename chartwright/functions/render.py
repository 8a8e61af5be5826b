"""Results as HTML and LaTeX text, for whoever shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwright.functions.grammar import Grammar

#: Entities of the characters that HTML reserves, and LaTeX's escapes.
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def html(text: Column) -> Column:
    """Text with the reserved characters as entities."""
    for ch, entity in ENTITIES:
        text = F.replace(text, F.lit(ch), F.lit(entity))
    return text


def html_list(df: DataFrame, keys: list[str], rank: str, text: str) -> DataFrame:
    """One ordered list for each key: its texts by rank."""
    items = F.array_sort(F.collect_list(F.struct(rank, html(F.col(text)).alias("t"))))
    return df.groupBy(*keys).agg(F.concat(F.lit("<ol>"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), x["t"], F.lit("</li>"))), ""), F.lit("</ol>")).alias("html"))


def latex(text: str) -> str:
    return "".join(ESCAPES.get(c, c) for c in text)


def latex_rules(grammar: Grammar) -> str:
    """The rules as rows of an align environment, alternatives of a symbol together."""
    by: dict[str, list[str]] = {}
    for a, r in grammar.rules:
        by.setdefault(a, []).append(r"\ ".join(rf"\text{{{latex(x)}}}" for x in r))
    rows = [rf"\text{{{latex(a)}}} &\rightarrow " + r" \mid ".join(rs) for a, rs in by.items()]
    return "\\begin{align*}\n" + " \\\\\n".join(rows) + "\n\\end{align*}"


def latex_chart(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One upper triangular table for each key of chart cells (keys, q, q2, nt): a row for each state that begins cells, a column for each that ends some."""
    box = cells.groupBy(*keys, "q", "q2").agg(F.array_join(F.array_sort(F.collect_list("nt")), ", ").alias("names"))
    size = F.max("q2").alias("n")
    rows = box.groupBy(*keys).agg(size, F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "q", "q2").alias("k"), "names"))).alias("at"))
    one = lambda q: F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda q2: F.coalesce(F.try_element_at("at", F.concat_ws(":", q.cast("string"), q2.cast("string"))), F.lit(""))), " & ")
    return rows.select(*keys, F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), one), " \\\\\n").alias("latex"))
