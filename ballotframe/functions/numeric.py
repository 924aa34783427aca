"""Rounding and ratio rules shared by all operators.

Integers are summed first and divided once at the end, so results do not
depend on the order in which partial aggregates arrive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(col: Column, places: int = 0) -> Column:
    """Round half up: BIGINT for ``places=0``, DOUBLE otherwise."""
    if places == 0:
        return F.floor(col + F.lit(0.5))
    scale = float(10**places)
    return F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def half_even(col: Column) -> Column:
    """Round half to even, as a BIGINT."""
    return F.rint(col).cast("bigint")


def truncate(col: Column) -> Column:
    """Drop the fraction, as a BIGINT."""
    return col.cast("bigint")


def pct(part: Column, whole: Column) -> Column:
    """``100 * part / whole``; NULL where ``whole`` is 0 or NULL."""
    return F.try_divide(F.lit(100.0) * part, whole)


def number_or_zero(col: Column, kind: str = "bigint") -> Column:
    """Blank, missing or malformed text becomes 0."""
    return F.coalesce(F.trim(col).try_cast(kind), F.lit(0).cast(kind))
