"""Totals by region, region group and country."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up, pct
from .results import ELECTION, top_party


def area_map(groups: DataFrame, regions: DataFrame, country: str = "unitedkingdom") -> DataFrame:
    """(area, region): each region as itself, as part of its groups, and of the country."""
    own = regions.select(F.col("region").alias("area"), "region")
    whole = regions.select(F.lit(country).alias("area"), "region")
    grouped = groups.select(F.col("region_group").alias("area"), "region")
    return own.unionByName(grouped).unionByName(whole).distinct()


def densify(df: DataFrame, parties: Sequence[str], keys: Sequence[str], total: str | None = None) -> DataFrame:
    """One row for each listed party in each (keys) group, ``votes`` 0 where it had none.

    Votes are summed side by side, one column per listed party, and unpivoted: a
    single aggregation, without pairing groups and parties first. ``total`` names an
    extra column with the sum of the listed parties.
    """
    sums = [
        F.coalesce(F.sum(F.when(F.col("party") == p, F.col("votes"))), F.lit(0)).alias(f"votes_{i}")
        for i, p in enumerate(parties)
    ]
    wide = df.groupBy(*keys).agg(*sums)
    extra = []
    if total is not None:
        extra = [sum((F.col(f"votes_{i}") for i in range(1, len(parties))), F.col("votes_0")).alias(total)]
    cells = [
        F.struct(F.lit(p).alias("party"), F.lit(i).alias("party_ord"), F.col(f"votes_{i}").alias("votes"))
        for i, p in enumerate(parties)
    ]
    return wide.select(*keys, *extra, F.inline(F.array(*cells)))


def regional_totals(
    result: DataFrame, seats: DataFrame, parties: Sequence[str], keys: Sequence[str] = ELECTION
) -> DataFrame:
    """Votes of every listed party per region, the turnout of those parties, and the share."""
    placed = result.join(seats.select("seat", "region"), "seat")
    dense = densify(placed, parties, [*keys, "region"], total="turnout")
    return dense.withColumn("share", F.try_divide(F.col("votes"), F.col("turnout")))


def vote_totals(
    pair: DataFrame, seats: DataFrame, areas: DataFrame, compare_votes: bool = True, sort: str | None = None,
    ascending: bool = False,
) -> DataFrame:
    """Seats, seat change, votes and vote share per party and area, plus a ``total`` row.

    Rows are summed per region before they fan out to the areas that contain it.
    """
    seat = Window.partitionBy("view_id", "seat")
    cells = (
        pair.withColumn("top", top_party().over(seat))
        .withColumn("prev_top", top_party("prev_votes").over(seat))
        .where(F.col("top.votes").isNotNull())
    )
    folded = F.when(F.col("party") == "others", "other").otherwise(F.col("party"))
    by_region = (
        cells.join(seats.select("seat", "region"), "seat")
        .groupBy("view_id", "region", folded.alias("party"))
        .agg(
            F.sum("votes").alias("votes"),
            F.sum("prev_votes").alias("prev_votes"),
            F.count_if(F.col("party") == F.col("top.party")).alias("seats"),
            F.count_if(
                (F.col("party") == F.col("prev_top.party")) & F.col("prev_top.votes").isNotNull()
            ).alias("prev_seats"),
        )
    )
    by_area = (
        by_region.join(areas, "region")
        .groupingSets([["view_id", "area", "party"], ["view_id", "area"]], "view_id", "area", "party")
        .agg(
            F.grouping("party").alias("is_total"),
            F.coalesce(F.sum("votes"), F.lit(0)).alias("votes"),
            F.coalesce(F.sum("prev_votes"), F.lit(0)).alias("prev_votes"),
            F.sum("seats").alias("seats"),
            F.sum("prev_seats").alias("prev_seats"),
        )
        .where(F.col("votes") > 0)
    )
    area = Window.partitionBy("view_id", "area")  # one row per party
    share = half_up(pct(F.col("votes"), F.max("votes").over(area)), 2)
    prev_share = half_up(pct(F.col("prev_votes"), F.max("prev_votes").over(area)), 2)
    is_party = F.col("is_total") == 0
    rows = by_area.select(
        "view_id",
        "area",
        F.when(is_party, F.col("party")).otherwise(F.lit("total")).alias("party"),
        "seats",
        F.when(is_party, F.col("seats") - F.col("prev_seats")).alias("seat_change"),
        "votes",
        (F.col("prev_votes") if compare_votes else F.lit(0).cast("bigint")).alias("prev_votes"),
        F.when(is_party, share).alias("vote_pct"),
        F.when(is_party & F.lit(compare_votes), half_up(share - prev_share, 2)).alias("vote_pct_change"),
    )
    if sort is None:
        return rows
    return rows.orderBy("view_id", "area", F.asc(sort) if ascending else F.desc(sort), "party")


def area_turnout(seat_rows: DataFrame, areas: DataFrame) -> DataFrame:
    """Votes over electorate per area; electorates are summed at seat grain."""
    by_region = seat_rows.groupBy("view_id", "region").agg(
        F.count(F.lit(1)).alias("seats"), F.sum("turnout").alias("votes"), F.sum("electorate").alias("electorate")
    )
    totals = by_region.join(areas, "region").groupBy("view_id", "area").agg(
        F.sum("seats").alias("seats"), F.sum("votes").alias("votes"), F.sum("electorate").alias("electorate")
    )
    return totals.withColumn("turnout_pct", half_up(pct(F.col("votes"), F.col("electorate")), 2))


def seats_won(seat_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return seat_rows.groupBy(*keys, "winner").agg(F.count(F.lit(1)).alias("seats"))


def overall_majority(seat_rows: DataFrame, keys: Sequence[str], n_seats: int | None = None) -> DataFrame:
    """The party with more than half of the seats and its overall majority, else a hung house."""
    per_party = seats_won(seat_rows, keys)
    house = F.lit(n_seats).cast("bigint") if n_seats is not None else F.col("seats_total")
    led = per_party.groupBy(*keys).agg(
        F.max(F.struct("seats", "winner")).alias("top"), F.sum("seats").alias("seats_total")
    )
    wins = F.col("top.seats") * 2 > house
    return led.select(
        *keys,
        house.alias("house_seats"),
        F.col("top.seats").alias("leader_seats"),
        F.when(wins, F.col("top.winner")).alias("leader"),
        F.when(wins, F.col("top.seats") * 2 - house).alias("overall_majority"),
        (~wins).alias("hung"),
    )


def seat_tally(
    seat_rows: DataFrame, listed: Sequence[str], keys: Sequence[str], rest: str = "others"
) -> DataFrame:
    """Seats of every listed party (0 included); all other winners count as ``rest``."""
    wide = seat_rows.groupBy(*keys).agg(
        *[F.count_if(F.col("winner") == p).alias(f"n_{i}") for i, p in enumerate(listed)],
        F.count_if(~F.col("winner").isin(list(listed))).alias("n_rest"),
    )
    cells = [F.struct(F.lit(p).alias("party"), F.col(f"n_{i}").alias("seats")) for i, p in enumerate(listed)]
    cells.append(F.struct(F.lit(rest).alias("party"), F.col("n_rest").alias("seats")))
    return wide.select(*keys, F.inline(F.array(*cells)))


def seat_change_vs_baseline(totals: DataFrame, baseline: DataFrame) -> DataFrame:
    """Seats won per (view, region, party) against a fixed baseline; a missing side counts 0."""
    won = totals.select("view_id", "region", F.col("winner").alias("party"), F.col("seats").alias("won"))
    present = won.select("view_id", "region").distinct()
    base = present.join(baseline, "region").select("view_id", "region", "party", F.col("seats").alias("base"))
    merged = won.select("*", F.lit(0).cast("bigint").alias("base")).unionByName(
        base.select("*", F.lit(0).cast("bigint").alias("won"))
    )
    return merged.groupBy("view_id", "region", "party").agg(
        F.sum("won").alias("seats"), F.sum("base").alias("baseline_seats"),
        (F.sum("won") - F.sum("base")).alias("seat_change"),
    )


def group_shares(prev: DataFrame, members: DataFrame, group_party: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Previous percent of each group's parties, over the whole group and per region.

    ``prev``: keys, region, party, votes, one row for every party of every region as
    ``regional_totals`` gives them, other already folded. ``members``: region_group,
    region. ``group_party``: region_group, party: the parties counted in that group.
    """
    group = [*keys, "region_group"]
    cells = prev.join(members, "region").join(group_party, ["region_group", "party"])
    # the coarsest grain comes first: the finer ones then need no shuffle of their own
    counted = (
        cells.withColumn("_group_total", F.sum("votes").over(Window.partitionBy(*group)))
        .withColumn("_group_votes", F.sum("votes").over(Window.partitionBy(*group, "party")))
        .withColumn("_region_total", F.sum("votes").over(Window.partitionBy(*group, "region")))
    )
    return counted.select(
        *group, "region", "party", "votes",
        pct(F.col("votes"), F.col("_region_total")).alias("region_pct"),
        pct(F.col("_group_votes"), F.col("_group_total")).alias("overall_pct"),
    )
