"""A small register machine, run in bulk: 255 words of memory, an accumulator, seven opcodes, a step limit.

Machines are rows (vid, mem, ...); a batch of them is one matrix, and each step moves all that run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of memory, bits of a word and of an opcode, outputs kept, step limit, opcodes.
MEMORY, WORD, OPCODE, OUTPUTS, MAX_STEPS = 255, (1 << 29) - 1, 3, 3, 1_000_000
LOD, ADD, MUL, STO, BNZ, PRI = 1, 2, 3, 4, 5, 7


def packed(op: int, arg: int) -> int:
    return (arg & WORD) << OPCODE | op


def run_matrix(mem: np.ndarray, max_steps: int = MAX_STEPS) -> dict[str, np.ndarray]:
    """Runs machines given as rows of memory until each halts or reaches the limit."""
    mem = mem.astype(np.int64).copy()
    n = len(mem)
    pc, acc, steps, count = (np.zeros(n, dtype=np.int64) for _ in range(4))
    out, halted, live = np.zeros((n, OUTPUTS), dtype=np.int64), np.zeros(n, dtype=bool), np.arange(n)
    while len(live):
        word = mem[live, pc[live] % MEMORY]
        op, arg = word & 7, word >> OPCODE
        stop = (op == 0) | (op == 6)
        halted[live[stop]] = True
        live, op, arg = live[~stop], op[~stop], arg[~stop]
        at = arg % MEMORY
        value = mem[live, at]
        a = acc[live]
        jump = (op == BNZ) & (a != 0)
        acc[live] = np.select([op == LOD, op == ADD, op == MUL], [arg & WORD, (a + value) & WORD, ((a & WORD) * (value & WORD)) & WORD], a)
        s = op == STO
        mem[live[s], at[s]] = a[s] & WORD
        p = (op == PRI) & (count[live] < OUTPUTS)
        out[live[p], count[live[p]]] = value[p]
        count[live[p]] += 1
        pc[live] = np.where(jump, arg & WORD, (pc[live] + 1) & WORD)
        steps[live] += 1
        done = steps[live] >= max_steps
        halted[live[done]] = True
        live = live[~done]
    return {"pc": pc & WORD, "acc": acc, "steps": steps, "halted": halted, "count": count, "out": out, "mem": mem}


def run(machines: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Rows (vid, pc, acc, steps, halted, out) of machines (vid, program array<int>)."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mem = np.zeros((len(pdf), MEMORY), dtype=np.int64)
            for i, p in enumerate(pdf["program"]):
                if len(p) > MEMORY:
                    raise ValueError(f"a program of {len(p)} words doesn't fit {MEMORY}")
                mem[i, : len(p)] = p
            got = run_matrix(mem, max_steps)
            outs = [list(map(int, o[:c])) for o, c in zip(got["out"], got["count"], strict=True)]
            yield pd.DataFrame({"vid": pdf["vid"], "pc": got["pc"], "acc": got["acc"], "steps": got["steps"], "halted": got["halted"], "out": outs})

    return machines.select("vid", "program").mapInPandas(go, "vid long, pc long, acc long, steps long, halted boolean, out array<long>")


def histogram(ran: DataFrame, max_steps: int = MAX_STEPS, width: int = 10) -> DataFrame:
    """Machines by steps: buckets of a width, timed out, not halted."""
    low = F.expr(f"steps div {width} * {width}")
    name = F.when(~F.col("halted"), "running").when(F.col("steps") >= max_steps, "timed out").otherwise(F.concat(low.cast("string"), F.lit(".."), (low + width - 1).cast("string")))
    return ran.groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))


def halted_count(ran: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    return ran.agg(F.count_if(F.col("halted") & (F.col("steps") < max_steps)).alias("n_halted"))


def longest(ran: DataFrame, k: int = 5) -> DataFrame:
    """The k machines of most steps."""
    return ran.orderBy(F.desc("steps"), "vid").limit(k)
