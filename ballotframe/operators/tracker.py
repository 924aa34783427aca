"""Poll tracker: point filters, moving average, model history."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import with_ordinal

# Default date bounds of the tracker.
DEFAULT_START = dt.date(2015, 5, 6)
DEFAULT_END = dt.date(2017, 6, 8)
MAJORITY_LINE = 326


def clamp_range(
    start: dt.date | None, end: dt.date | None, lower: dt.date = DEFAULT_START, upper: dt.date = DEFAULT_END
) -> tuple[dt.date, dt.date]:
    """Missing or wider bounds fall back to the default bounds."""
    return max(start or lower, lower), min(end or upper, upper)


def toggle_company(selected: Sequence[str], company: str) -> list[str]:
    chosen = list(selected)
    return [c for c in chosen if c != company] if company in chosen else [*chosen, company]


def filter_points(
    points: DataFrame,
    start: dt.date,
    end: dt.date,
    companies: Sequence[str] | None = None,
    date: str = "fieldwork_date",
) -> DataFrame:
    rows = points.where(F.col(date).between(F.lit(start), F.lit(end)))
    return rows if companies is None else rows.where(F.col("company").isin(list(companies)))


def companies(points: DataFrame) -> DataFrame:
    return points.select("company").distinct()


def moving_average(
    points: DataFrame,
    n: int = 12,
    keys: Sequence[str] = ("party",),
    order: Sequence[str] = ("fieldwork_date", "code"),
    value: str = "pct",
    block_rows: int = 50_000,
) -> DataFrame:
    """Adds ``moving``: mean of the last ``n`` points of each series, fewer at its start.

    Series are few and long. Points are numbered within their series by ranges of the order, with counts of each range
    summed before it, and cut into blocks of ``block_rows`` points by their numbers. The last ``n - 1`` points of a block
    are sent to the next one, too; then all blocks are averaged independently. Blocks are alike in size however many points
    a day has and however many have the same code; points equal in ``order`` count in any order.
    """
    at, block = "_at_point", "_block"
    length = max(block_rows, n)
    rows = with_ordinal(points, [F.col(c).asc() for c in order], at, keys)
    here = F.floor((F.col(at) - 1) / length)
    in_tail = F.pmod(F.col(at) - 1, F.lit(length)) >= length - (n - 1)
    twice = F.explode(F.when(in_tail, F.array(here, here + 1)).otherwise(F.array(here)))
    within = Window.partitionBy(*keys, block).orderBy(at).rowsBetween(-(n - 1), 0)
    moved = rows.withColumn(block, twice).withColumn("moving", F.avg(value).over(within))
    return moved.where(F.col(block) == here).drop(at, block)


def model_series(
    history: DataFrame, start: dt.date, end: dt.date, line: int = MAJORITY_LINE, date: str = "date"
) -> DataFrame:
    """Seats per party over time within the dates, with the majority line beside them."""
    return history.where(F.col(date).between(F.lit(start), F.lit(end))).withColumn("majority_line", F.lit(line))


def upsert_snapshot(history: DataFrame, snapshot: DataFrame, date: str = "date") -> DataFrame:
    """History with the snapshot's dates replaced by the snapshot.

    Where the history is stored in a folder for each date, ``tables.replace_partitions`` does so without reading it.
    """
    replaced = snapshot.select(date).distinct()
    return history.join(replaced, date, "left_anti").unionByName(snapshot)
