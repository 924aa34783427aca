"""Arrays to rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpack(df: DataFrame, kept: Sequence[str | Column], generator: Column, present: str) -> DataFrame:
    """Rows of a computed array, by an *outer* generator; empty arrays are dropped afterwards.

    For an inner generator the optimizer adds a filter on the size of the array and
    pushes it down as far as it goes, which computes the whole array once more.
    """
    return df.select(*kept, generator).where(F.col(present).isNotNull())


def let(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), build), 1)


def running_depth(turns: Column) -> Column:
    """How deep each place of an array of turns (1 in, -1 out, 0 neither) is, itself included; there is no way out at depth 0.

    An array that a fold appends to is copied at each step, so the turns are cut into blocks of about the square root of
    their number; sums and least sums are found within blocks and over blocks, then put together.
    """
    pair = "struct<sum: int, low: int>"
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("low"), F.array().cast(f"array<{pair}>").alias("all"))

    def add(state: Column, s: Column, low: Column) -> Column:
        now = F.struct((state["sum"] + s).alias("sum"), F.least(state["low"], state["sum"] + low).alias("low"))
        return F.struct(now["sum"].alias("sum"), now["low"].alias("low"), F.concat(state["all"], F.array(now)).alias("all"))

    def in_block(block: Column) -> Column:
        return F.aggregate(block, start, lambda state, t: add(state, t, t), lambda state: state["all"])

    def whole(blocks: Column) -> Column:
        last = F.transform(blocks, lambda b: F.element_at(b, -1))
        before = F.aggregate(last, start, lambda state, b: add(state, b["sum"], b["low"]), lambda state: state["all"])
        none = F.array(F.struct(F.lit(0).alias("sum"), F.lit(0).alias("low")))
        paired = F.arrays_zip(blocks.alias("block"), F.concat(none, before).alias("base"))

        def depth(base: Column, p: Column) -> Column:
            low = F.least(base["low"], base["sum"] + p["low"])
            return base["sum"] + p["sum"] - low

        each = F.filter(paired, lambda x: x["block"].isNotNull())
        return F.flatten(F.transform(each, lambda x: F.transform(x["block"], lambda p: depth(x["base"], p))))

    size = F.greatest(F.ceil(F.sqrt(F.size(turns))).cast("int"), F.lit(1))
    firsts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(turns), F.lit(1)), size), lambda a: a <= F.size(turns))
    return let(F.transform(firsts, lambda a: in_block(F.slice(turns, a, size))), whole)
