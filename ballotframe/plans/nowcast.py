"""Polls and the last result to projected seats, as one lazy plan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.areas import regional_totals
from ..operators.polls import blend, blend_history, correct_overlaps, exclude_polls, to_fraction, with_weight
from ..operators.project import project, regional_change
from ..operators.results import ELECTION, adjust_seats, fold_others


@dataclass(frozen=True)
class NowcastDims:
    """Tables the nowcast needs beside results and polls."""

    pollster: DataFrame
    crosswalk: DataFrame
    overlap_rules: DataFrame
    adjustments: DataFrame | None = None
    parties: Sequence[str] = ()


AsOf = dt.date | str | Column | Sequence[dt.date | str]


def swing_keys(as_of: AsOf, keys: Sequence[str]) -> list[str]:
    """Keys of a swing: with several dates each has its own."""
    return [*keys, "as_of"] if isinstance(as_of, list | tuple) else list(keys)


def regional_swing(
    result: DataFrame, seats: DataFrame, polls: DataFrame, dims: NowcastDims,
    as_of: AsOf, decay: float = 0.7, keys: Sequence[str] = ELECTION,
) -> DataFrame:
    """Change of every party's regional share since the last result, for one date or for each of a list of dates.

    Polls after a date never count for it. Many dates are one scan over the days of the polls.
    """
    old = regional_totals(result, seats, dims.parties, keys)
    corrected = to_fraction(correct_overlaps(exclude_polls(polls), dims.overlap_rules), dims.pollster)
    if isinstance(as_of, list | tuple):
        estimates = blend_history(corrected, dims.pollster, old, dims.crosswalk, as_of, decay, keys)
    else:
        estimates = blend(with_weight(corrected, dims.pollster, as_of, decay), old, dims.crosswalk, keys)
    return regional_change(estimates, swing_keys(as_of, keys))


def nowcast(
    result: DataFrame, seats: DataFrame, polls: DataFrame, dims: NowcastDims,
    as_of: AsOf, decay: float = 0.7, keys: Sequence[str] = ELECTION,
) -> DataFrame:
    """Projected seats (packed) on ``as_of``; with a list of dates once for each of them (column ``as_of``)."""
    base = result if dims.adjustments is None else adjust_seats(result, dims.adjustments, keys)
    base = fold_others(base, keys)
    change = regional_swing(base, seats, polls, dims, as_of, decay, keys)
    return project(base, seats, change, keys, change_keys=swing_keys(as_of, keys))
