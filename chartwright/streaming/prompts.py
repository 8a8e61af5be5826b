"""Structured Streaming front end: prompts in, repairs out.

A prompt is (editor, ts, line). Within a micro-batch only an editor's last prompt counts, and lines
repaired before, in the watermark's reach, aren't repaired again. Repairs are the batch operator's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chartwright.functions.grammar import Grammar
from chartwright.functions.text import tokenise
from chartwright.operators.repairing import repairs


def latest(prompts: DataFrame) -> DataFrame:
    """Each editor's last prompt of a batch."""
    return prompts.groupBy("editor").agg(F.max_by(F.struct("ts", "line"), F.struct("ts", "line")).alias("p")).select("editor", "p.ts", "p.line")


def answered(batch: DataFrame, grammar: Grammar, radius: int = 2, k: int = 10) -> DataFrame:
    """Repairs of a batch's prompts: editor, ts, line, rank, dist, repair."""
    return repairs(latest(batch).withColumn("tokens", tokenise(F.col("line"))), grammar, radius, 1, k)


def serve(prompts: DataFrame, grammar: Grammar, sink: Callable[[DataFrame, int], None], checkpoint: str, late: str = "1 minute", trigger: dict | None = None) -> StreamingQuery:
    """Runs a stream of prompts; sink gets each batch's repairs."""
    fresh = prompts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["editor", "line"])
    return fresh.writeStream.foreachBatch(lambda batch, n: sink(answered(batch, grammar), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def settled(prompts: DataFrame, gap: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """One row for each pause in an editor's typing: the last line before a gap."""
    return prompts.withWatermark("ts", late).groupBy("editor", F.session_window("ts", gap).alias("w")).agg(F.max_by("line", F.struct("ts", "line")).alias("line"))


def poster(url: str, timeout: float = 30.0) -> Callable[[DataFrame, int], None]:
    """A sink for serve(): each partition of a batch's repairs is posted as one body of JSON lines, from where it is."""

    def post(rows) -> None:
        import json
        import urllib.request

        body = "\n".join(json.dumps(r.asDict(recursive=True), default=str) for r in rows)
        if body:
            request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/x-ndjson"})
            urllib.request.urlopen(request, timeout=timeout).close()

    return lambda df, _: df.foreachPartition(post)
