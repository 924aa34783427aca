"""Regional polls: exclusions, overlap correction, weights, swing and blend.

``poll`` frames hold (code, company, fieldwork_date, area, party, n, total) with
one row for every party of a poll area; a party the poll did not ask about has
``n`` 0, or NULL when read with ``blank_as_missing``.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up, pct
from ..sources import dims

POLL_KEYS = ("code", "company", "fieldwork_date")


def exclude_polls(
    polls: DataFrame, codes: Sequence[int] = tuple(dims.MODEL_EXCLUDED_CODES), companies: Sequence[str] = ()
) -> DataFrame:
    return polls.where(~F.col("code").isin(list(codes)) & ~F.col("company").isin(list(companies)))


def with_display_company(polls: DataFrame, display: DataFrame, rest: str = "others") -> DataFrame:
    """Adds ``shown_company``: own name, the name variants are merged under, or ``rest``."""
    return (
        polls.join(display, "company", "left")
        .withColumn("shown_company", F.coalesce("shown", F.lit(rest)))
        .drop("shown")
    )


def correct_overlaps(polls: DataFrame, rules: DataFrame) -> DataFrame:
    """Replaces overlapping areas by signed sums of the published areas.

    ``rules``: company, area, target_area, factor. An area without rules keeps its
    numbers; a target is only written for polls that publish it themselves, and an
    area that appears in no target of its own is dropped.
    """
    mapped = polls.join(rules, ["company", "area"], "left")
    target = F.coalesce("target_area", "area")
    factor = F.coalesce("factor", F.lit(1))
    return (
        mapped.groupBy(*POLL_KEYS, target.alias("target"), "party")
        .agg(
            F.max(F.col("area") == target).alias("published"),
            F.sum(F.col("n") * factor).alias("n"),
            F.sum(F.col("total") * factor).alias("total"),
        )
        .where("published")
        .select(*POLL_KEYS, F.col("target").alias("area"), "party", "n", "total")
    )


def to_fraction(polls: DataFrame, pollster: DataFrame) -> DataFrame:
    """Adds ``fraction``: counts over the area total, percents over 100, or the number as it is."""
    kinds = pollster.select("company", "scale_kind")
    n = F.col("n").cast("double")
    fraction = (
        F.when(F.col("scale_kind") == "count", F.try_divide(n, F.col("total")))
        .when(F.col("scale_kind") == "percent", n / F.lit(100.0))
        .otherwise(n)
    )
    return polls.join(kinds, "company").withColumn("fraction", fraction).drop("scale_kind")


def with_weight(polls: DataFrame, pollster: DataFrame, as_of: dt.date | str | Column, decay: float = 0.7) -> DataFrame:
    """Polls up to ``as_of`` with ``weight`` = base weight * decay ^ (days since fieldwork), or the pollster's fixed weight."""
    day = as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")
    days = F.datediff(day, F.col("fieldwork_date"))
    weights = pollster.select("company", "base_weight", "fixed_weight")
    aged = F.col("base_weight") * F.pow(F.lit(decay), days)
    return (
        polls.where(F.col("fieldwork_date") <= day)
        .join(weights, "company")
        .withColumn("weight", F.coalesce("fixed_weight", aged))
        .drop("base_weight", "fixed_weight")
    )


def explode_areas(polls: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """One row for every region a poll area covers."""
    return polls.join(crosswalk.select("company", "area", "region"), ["company", "area"])


def unmatched_areas(polls: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Company and area pairs that no region is known for."""
    known = crosswalk.select("company", "area").distinct()
    return polls.select("company", "area").distinct().join(known, ["company", "area"], "left_anti")


def area_shares(old: DataFrame, crosswalk: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Previous share of every party in every poll area: summed votes over summed turnout.

    ``old``: keys, region, party, votes, turnout, with one row for every party of a region.
    """
    return (
        old.join(crosswalk.select("company", "area", "region"), "region")
        .groupBy(*keys, "company", "area", "party")
        .agg(F.try_divide(F.sum("votes"), F.sum("turnout")).alias("area_share"))
    )


def area_swing(fractions: DataFrame, old: DataFrame, crosswalk: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``area_share`` and ``swing`` (fraction minus previous share) per poll, area and party."""
    shares = area_shares(old, crosswalk, keys)
    return fractions.join(shares, ["company", "area", "party"]).withColumn(
        "swing", F.col("fraction") - F.col("area_share")
    )


def blend(weighted: DataFrame, old: DataFrame, crosswalk: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Regional estimate: sum of weight * (previous regional share + swing) over all polls of a region.

    The sum is linear in the fractions, so polls collapse to one row per company,
    area and party before they are spread over regions. Keys that the polls carry as well,
    such as a date or a scenario, are kept apart.
    """
    own = [k for k in keys if k in weighted.columns]
    sums = (
        weighted.where(F.col("fraction").isNotNull())
        .groupBy(*own, "company", "area", "party")
        .agg(F.sum(F.col("weight") * F.col("fraction")).alias("wf"), F.sum("weight").alias("w"))
    )
    swings = (
        sums.join(area_shares(old, crosswalk, keys), [*own, "company", "area", "party"])
        .join(crosswalk.select("company", "area", "region"), ["company", "area"])
        .groupBy(*keys, "region", "party")
        .agg(F.sum(F.col("wf") - F.col("w") * F.col("area_share")).alias("ws"), F.sum("w").alias("w"))
    )
    joined = old.join(swings, [*keys, "region", "party"], "left")
    return joined.select(
        *keys, "region", "party", F.col("share").alias("old_share"),
        (F.col("share") * F.col("w") + F.col("ws")).alias("estimate"),
        F.col("w").isNotNull().alias("had_polls"),
    )


def decay_sums(
    rows: DataFrame, keys: Sequence[str], day: str, decayed: Sequence[str], plain: Sequence[str], decay: float
) -> DataFrame:
    """Running sums over the days of a key, in place of the columns: of ``decayed`` values with ``decay`` for each day since.

    ``rows`` has one row for each key and day. The sum of a day is that of an earlier one times decay ^ (days between)
    plus what came since, so one scan over the days gives the sums of all of them. Within a block of days, values are scaled
    to its start (blocks are short enough for that to be exact in doubles) and summed; the blocks before it, a
    number for each, are carried in. Rows meet by key: as many as there are days.
    """
    if decay <= 0:
        raise ValueError("decay must be positive")
    length = 1 << 20 if decay == 1 else max(1, int(100 / abs(math.log10(decay))))
    number = F.datediff(F.col(day), F.lit("2000-01-01").cast("date"))
    power = lambda days: F.pow(F.lit(float(decay)), days)
    block, since = F.floor(number / F.lit(length)), F.pmod(number, F.lit(length))
    scaled = rows.withColumns({"_block": block, "_since": since})
    scaled = scaled.withColumns({c: F.col(c) / power(F.col("_since")) for c in decayed})
    inside = Window.partitionBy(*keys, "_block").orderBy(day)
    series = Window.partitionBy(*keys)
    last = F.lead(day).over(inside).isNull()
    sums = scaled.withColumns({c: F.sum(c).over(inside) for c in decayed}).withColumn("_last", last)
    sums = sums.withColumns({c: F.sum(c).over(series.orderBy(day)) for c in plain})
    totals = F.collect_list(F.when(F.col("_last"), F.struct("_block", *decayed))).over(series)
    sums = sums.withColumn("_totals", totals)
    before = F.filter("_totals", lambda t: t["_block"] < F.col("_block"))

    def whole(c: str) -> Column:
        carried = F.aggregate(before, F.lit(0.0), lambda s, t: s + t[c] * power((F.col("_block") - t["_block"]) * length))
        return (F.col(c) + carried) * power(F.col("_since"))

    return sums.withColumns({c: whole(c) for c in decayed}).drop("_block", "_since", "_last", "_totals")


def blend_history(
    polls: DataFrame, pollster: DataFrame, old: DataFrame, crosswalk: DataFrame, dates: Sequence[dt.date | str],
    decay: float = 0.7, keys: Sequence[str] = (),
) -> DataFrame:
    """``blend`` of the polls up to each of many dates (column ``as_of``), in one scan over the days.

    ``polls`` have fractions, no weights yet. They collapse to a row for each region, party and day before dates come
    in; no poll is repeated for a date. ``old``: as for ``blend``, without dates.
    """
    day, series = "as_of", [*keys, "region", "party"]
    daily = (
        polls.where(F.col("fraction").isNotNull())
        .groupBy("company", "area", "party", F.col("fieldwork_date").alias(day))
        .agg(F.sum("fraction").alias("f"), F.count(F.lit(1)).alias("n"))
        .join(pollster.select("company", "base_weight", "fixed_weight"), "company")
    )
    area = Window.partitionBy(*keys, "company", "area", "party")  # a row for each region of the area
    share = F.try_divide(F.sum("votes").over(area), F.sum("turnout").over(area))
    placed = old.join(crosswalk.select("company", "area", "region"), "region").select(
        *keys, "company", "area", "region", "party", share.alias("area_share")
    )
    moved = F.col("f") - F.col("n") * F.col("area_share")
    aged = F.when(F.col("fixed_weight").isNull(), F.col("base_weight"))
    zero = F.lit(0.0)
    sums = daily.join(placed, ["company", "area", "party"]).groupBy(*series, day).agg(
        F.coalesce(F.sum(aged * moved), zero).alias("ws"), F.coalesce(F.sum(aged * F.col("n")), zero).alias("w"),
        F.coalesce(F.sum(F.col("fixed_weight") * moved), zero).alias("fixed_ws"),
        F.coalesce(F.sum(F.col("fixed_weight") * F.col("n")), zero).alias("fixed_w"), F.sum("n").alias("n"),
    )
    days = F.explode(F.array(*(F.lit(str(d)).cast("date") for d in dates))).alias(day)
    asked = old.select(*series, F.col("share").alias("old_share"), F.lit(True).alias("asked"), days)
    rows = sums.unionByName(asked, allowMissingColumns=True).groupBy(*series, day).agg(
        F.max("old_share").alias("old_share"), F.max("asked").alias("asked"),
        *(F.coalesce(F.sum(c), zero).alias(c) for c in ("ws", "w", "fixed_ws", "fixed_w")), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
    )
    seen = decay_sums(rows, series, day, ["ws", "w"], ["fixed_ws", "fixed_w", "n"], decay).where("asked")
    estimate = F.col("old_share") * (F.col("w") + F.col("fixed_w")) + F.col("ws") + F.col("fixed_ws")
    polled = F.col("n") > 0
    return seen.select(*series, day, "old_share", F.when(polled, estimate).alias("estimate"), polled.alias("had_polls"))


def poll_points(
    polls: DataFrame,
    parties: Sequence[str] = tuple(dims.TRACKER_PARTIES),
    repeated: Sequence[tuple[str, str]] = tuple(dims.REPEATED_AREAS),
    size_weighted: Sequence[str] = ("yougov",),
    rest: str = "others",
) -> DataFrame:
    """National percent of every listed party in every poll, to one decimal.

    Areas that repeat voters of another area are left out; percents of size-weighted
    companies are turned into voters first; unlisted parties count as ``rest``.
    """
    keep = F.lit(True)
    for company, area in repeated:
        keep = keep & ~((F.col("company") == company) & (F.col("area") == area))
    votes = F.when(
        F.col("company").isin(list(size_weighted)), F.col("n") * F.col("total") / F.lit(100.0)
    ).otherwise(F.col("n").cast("double"))
    wide = polls.where(keep).withColumn("v", votes).groupBy(*POLL_KEYS).agg(
        *[F.sum(F.when(F.col("party") == p, F.col("v"))).alias(f"v_{i}") for i, p in enumerate(parties)],
        F.sum(F.when(~F.col("party").isin(list(parties)), F.col("v"))).alias("v_rest"),
        F.sum("v").alias("v_all"),
    )
    cells = [
        F.struct(F.lit(p).alias("party"),
                 half_up(F.coalesce(pct(F.col(c), F.col("v_all")), F.lit(0.0)), 1).alias("pct"))
        for p, c in [*[(p, f"v_{i}") for i, p in enumerate(parties)], (rest, "v_rest")]
    ]
    return wide.select(*POLL_KEYS, F.inline(F.array(*cells)))


def latest_poll(polls: DataFrame, reserved: Sequence[int] = tuple(dims.LATEST_EXCLUDED_CODES)) -> DataFrame:
    """Company of the highest poll code that is not reserved."""
    rows = polls.where(~F.col("code").isin(list(reserved)))
    return rows.agg(F.max("code").alias("code"), F.max_by("company", F.struct("code", "company")).alias("company"))


def latest_date(polls: DataFrame, floor: str = "2015-05-01") -> DataFrame:
    start = F.lit(floor).cast("date")
    return polls.agg(F.coalesce(F.greatest(F.max("fieldwork_date"), start), start).alias("latest_date"))
