"""Pseudo-random numbers of 32 bits as columns of longs: a mixer, a shift register, and draws below a bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mask of 32 bits; the mixer's increment, shifts and factors; the register's shifts; draws before the last one is taken as it is.
MASK = (1 << 32) - 1
GOLDEN, ROUNDS, LAST = 0x9E3779B9, ((16, 0x85EBCA6B), (13, 0xC2B2AE35)), 16
SHIFTS = (13, -17, 5)
DRAWS = 32


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2^32, in two halves so that no product leaves 63 bits."""
    high = F.shiftright(x, 16) * (factor & MASK)
    return _low(F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + x.bitwiseAND(F.lit(0xFFFF)) * (factor & MASK))


def mixed(x: Column) -> Column:
    """A number whose bits all depend on all bits of x."""
    z = _low(x.cast("long") + GOLDEN)
    for shift, factor in ROUNDS:
        z = _times(z.bitwiseXOR(F.shiftright(z, shift)), factor)
    return z.bitwiseXOR(F.shiftright(z, LAST))


def shifted(x: Column) -> Column:
    """The register's next state; 0 stays 0."""
    for s in SHIFTS:
        x = _low(x.bitwiseXOR(F.shiftleft(x, s) if s > 0 else F.shiftright(x, -s)))
    return x


def below(state: Column, bound: int) -> Column:
    """The first of DRAWS states after this one that favours no remainder, modulo the bound; the next state's if there is none."""
    least = (1 << 32) % bound
    begin = F.struct(state.alias("s"), F.lit(None).cast("long").alias("got"))

    def draw(acc: Column, _: Column) -> Column:
        s = F.when(acc["got"].isNull(), shifted(acc["s"])).otherwise(acc["s"])
        return F.struct(s.alias("s"), F.coalesce(acc["got"], F.when(s >= least, s % bound)).alias("got"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(DRAWS)), begin, draw, lambda acc: F.coalesce(acc["got"], shifted(acc["s"]) % bound))
