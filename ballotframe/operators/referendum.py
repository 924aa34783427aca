"""Leave/remain estimates per seat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_outcome(df: DataFrame) -> DataFrame:
    """Adds ``current``: the side with the larger share."""
    return df.withColumn("current", F.when(F.col("leave") > F.col("remain"), "leave").otherwise("remain"))


def filter_referendum(
    df: DataFrame,
    leave: tuple[float, float] = (0.0, 100.0),
    current: str | None = None,
    region: str | Sequence[str] | None = None,
    winner2015: str | Sequence[str] | None = None,
    mark: bool = False,
) -> DataFrame:
    """Seats meeting every criterion; with ``mark``, all seats with a ``filtered`` flag."""
    keep = F.col("leave").between(F.lit(float(leave[0])), F.lit(float(leave[1])))
    if current is not None:
        keep = keep & (F.col("current") == current)
    for column, wanted in (("region", region), ("winner2015", winner2015)):
        if wanted is not None:
            keep = keep & F.col(column).isin([wanted] if isinstance(wanted, str) else list(wanted))
    keep = F.coalesce(keep, F.lit(False))
    return df.withColumn("filtered", keep) if mark else df.where(keep)


def with_ref_intensity(df: DataFrame) -> DataFrame:
    """(20/3) * (winning percent / 100 - 0.5); 0 where a ``filtered`` flag is false."""
    winning = F.when(F.col("current") == "leave", F.col("leave")).otherwise(F.col("remain"))
    intensity = F.lit(20.0 / 3.0) * (winning / F.lit(100.0) - F.lit(0.5))
    if "filtered" in df.columns:
        intensity = F.when(F.col("filtered"), intensity).otherwise(F.lit(0.0))
    return df.withColumn("intensity", intensity)


def referendum_tally(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    leave = F.count_if(F.col("current") == "leave")
    total = F.count(F.lit(1))
    return df.groupBy(*keys).agg(total.alias("total"), (total - leave).alias("remain_seats"), leave.alias("leave_seats"))
