"""Seat results: turnout, shares, winners, election pairs, overrides, audits.

``result`` frames hold one row per (keys, seat, party) with ``votes`` and
``party_ord`` (document order; the earlier party wins a tie). Groups by seat
therefore hold at most one row per party.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import pct

ELECTION = ("election_id",)
VIEW = ("view_id",)


def top_party(votes: str = "votes") -> Column:
    """Aggregate expression: the (votes, -ord, party) struct of the leading party."""
    return F.max(F.struct(F.col(votes).alias("votes"), (-F.col("party_ord")).alias("neg_ord"), F.col("party")))


def seat_turnout(result: DataFrame, keys: Sequence[str] = ELECTION) -> DataFrame:
    return result.groupBy(*keys, "seat").agg(F.sum("votes").alias("turnout"))


def with_turnout(result: DataFrame, keys: Sequence[str] = ELECTION) -> DataFrame:
    seat = Window.partitionBy(*keys, "seat")
    return result.withColumn("turnout", F.sum("votes").over(seat))


def with_shares(result: DataFrame, keys: Sequence[str] = ELECTION) -> DataFrame:
    """Adds ``turnout`` and ``share_pct`` of every party in its seat."""
    return with_turnout(result, keys).withColumn("share_pct", pct(F.col("votes"), F.col("turnout")))


def fold_others(
    result: DataFrame, keys: Sequence[str] = ELECTION, source: str = "others", target: str = "other"
) -> DataFrame:
    """Merges one party code into another and sums their votes."""
    party = F.when(F.col("party") == source, F.lit(target)).otherwise(F.col("party"))
    return (
        result.withColumn("party", party)
        .groupBy(*keys, "seat", "party")
        .agg(F.sum("votes").alias("votes"), F.min("party_ord").alias("party_ord"))
    )


def adjust_seats(result: DataFrame, rules: DataFrame, keys: Sequence[str] = ELECTION) -> DataFrame:
    """Raises one party of the listed seats, or seeds it from another, which is dropped.

    ``rules``: seat, party, factor, seed_from, seed_share, drop_party; one row per seat.
    """
    rule = rules.select("seat", F.col("party").alias("to_party"), "factor", "seed_from", "seed_share", "drop_party")
    listed = result.join(rule, "seat", "left")
    votes = F.col("votes").cast("double")
    is_target = F.coalesce(F.col("party") == F.col("to_party"), F.lit(False))
    kept = listed.where(F.col("drop_party").isNull() | (F.col("party") != F.col("drop_party"))).select(
        *keys, "seat", "party", F.when(is_target, votes * F.col("factor")).otherwise(votes).alias("votes"), "party_ord"
    )
    seeded = (
        result.join(rule, "seat")
        .groupBy(*keys, "seat", F.col("to_party").alias("party"))
        .agg(
            F.max(F.col("party") == F.col("to_party")).alias("present"),
            F.coalesce(
                F.sum(F.when(F.col("party") == F.col("seed_from"), F.col("votes") * F.col("seed_share"))), F.lit(0.0)
            ).alias("votes"),
            (F.max("party_ord") + 1).alias("party_ord"),
        )
        .where(~F.col("present"))
        .drop("present")
    )
    return kept.unionByName(seeded)


def winners(result: DataFrame, keys: Sequence[str] = ELECTION) -> DataFrame:
    """One row per seat: winner, runner-up, majority and turnout."""
    seat = Window.partitionBy(*keys, "seat")
    ranked = seat.orderBy(F.desc("votes"), F.asc("party_ord"))
    rows = result.select(
        *keys,
        "seat",
        F.col("party").alias("winner"),
        F.col("votes").alias("winner_votes"),
        F.lead("party").over(ranked).alias("runner_up"),
        F.lead("votes").over(ranked).alias("runner_up_votes"),
        F.sum("votes").over(seat).alias("turnout"),
        F.row_number().over(ranked).alias("place"),
    ).where("place = 1").drop("place")
    majority = F.col("winner_votes") - F.coalesce(F.col("runner_up_votes"), F.lit(0))
    return rows.withColumn("majority", majority).withColumn("majority_pct", pct(majority, F.col("turnout")))


def election_pair(result: DataFrame, views: DataFrame) -> DataFrame:
    """Current and previous votes side by side for every view, in one scan.

    ``views``: view_id, current_id, previous_id. Output: view_id, seat, party,
    votes, prev_votes (NULL where the party did not stand), party_ord.
    """
    roles = views.select(
        "view_id",
        F.inline(
            F.array(
                F.struct(F.col("current_id").alias("election_id"), F.lit(True).alias("is_current")),
                F.struct(F.col("previous_id").alias("election_id"), F.lit(False).alias("is_current")),
            )
        ),
    )
    return (
        result.join(roles, "election_id")
        .groupBy("view_id", "seat", "party")
        .agg(
            F.sum(F.when(F.col("is_current"), F.col("votes"))).alias("votes"),
            F.sum(F.when(~F.col("is_current"), F.col("votes"))).alias("prev_votes"),
            F.min("party_ord").alias("party_ord"),
        )
    )


def compare(pair: DataFrame) -> DataFrame:
    """Parties of the current election with previous share, change and gain flag.

    The change of other/others is 0: their members differ between elections.
    """
    seat = Window.partitionBy("view_id", "seat")
    share = pct(F.col("votes"), F.col("turnout"))
    prev_share = F.coalesce(pct(F.col("prev_votes"), F.col("prev_turnout")), F.lit(0.0))
    rows = pair.select(
        "*",
        F.sum("votes").over(seat).alias("turnout"),
        F.sum("prev_votes").over(seat).alias("prev_turnout"),
        top_party().over(seat).alias("_top"),
        top_party("prev_votes").over(seat).alias("_prev_top"),
    ).where(F.col("votes").isNotNull())
    return rows.select(
        "view_id", "seat", "party", "party_ord", "votes", "prev_votes", "turnout", "prev_turnout",
        share.alias("share_pct"),
        prev_share.alias("prev_share_pct"),
        F.when(F.col("party").isin("other", "others"), F.lit(0.0)).otherwise(share - prev_share).alias("change_pct"),
        F.col("_top.party").alias("winner"),
        F.when(F.col("_prev_top.votes").isNotNull(), F.col("_prev_top.party")).alias("prev_winner"),
    ).withColumn("gain", F.col("winner") != F.col("prev_winner"))


def seat_summary(pair: DataFrame, seats: DataFrame) -> DataFrame:
    """One row per (view, seat): who holds it, who held it, by how much, plus seat attributes."""
    ranked = Window.partitionBy("view_id", "seat").orderBy(F.desc_nulls_last("votes"), F.asc("party_ord"))
    grouped = (
        pair.withColumn("next_votes", F.lead("votes").over(ranked))
        .groupBy("view_id", "seat")
        .agg(
            F.max(
                F.struct("votes", (-F.col("party_ord")).alias("neg_ord"), "party", "next_votes")
            ).alias("top"),
            top_party("prev_votes").alias("prev_top"),
            F.sum("votes").alias("turnout"),
            F.sum("prev_votes").alias("prev_turnout"),
        )
        .where(F.col("turnout").isNotNull())
    )
    majority = F.col("top.votes") - F.coalesce(F.col("top.next_votes"), F.lit(0))
    return grouped.join(seats, "seat").select(
        "view_id",
        "seat",
        *[c for c in seats.columns if c != "seat"],
        F.col("top.party").alias("winner"),
        F.when(F.col("prev_top.votes").isNotNull(), F.col("prev_top.party")).alias("prev_winner"),
        "turnout",
        "prev_turnout",
        majority.alias("majority"),
        pct(majority, F.col("turnout")).alias("majority_pct"),
        pct(F.col("turnout"), F.col("electorate")).alias("turnout_pct"),
    )


def apply_overrides(
    base: DataFrame, overrides: DataFrame, keys: Sequence[str] = ELECTION
) -> tuple[DataFrame, DataFrame]:
    """Replaces whole seats of the same ``keys``; returns (merged, override rows of seats the base does not have).

    Both sides are packed to one row per seat (its parties) and meet in one full outer join.
    """
    seat = [*keys, "seat"]
    rest = [c for c in base.columns if c not in seat]

    def packed(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*seat).agg(F.collect_list(F.struct(*rest)).alias(name))

    both = packed(base, "_held").join(packed(overrides, "_new"), seat, "full_outer")
    merged = both.where(F.col("_held").isNotNull()).select(*seat, F.inline(F.coalesce("_new", "_held")))
    unmatched = both.where(F.col("_held").isNull()).select(*seat, F.inline("_new"))
    return merged.select(base.columns), unmatched.select(base.columns)


def audit_seats(
    declared: DataFrame, result: DataFrame, regions: DataFrame, keys: Sequence[str] = ELECTION
) -> DataFrame:
    """Declared winner, majority and region against values recomputed from the votes.

    ``declared``: keys, seat, region, current_declared, majority_declared.
    """
    known = regions.select("region", F.lit(True).alias("_known"))
    computed = winners(result, keys).select(*keys, "seat", "winner", "majority")
    return declared.join(computed, [*keys, "seat"], "left").join(known, "region", "left").select(
        *keys, "seat", "region", "current_declared", "winner", "majority_declared", "majority",
        F.coalesce(F.col("current_declared") == F.col("winner"), F.lit(False)).alias("winner_ok"),
        F.coalesce(F.col("majority_declared") == F.col("majority"), F.lit(False)).alias("majority_ok"),
        F.col("_known").isNotNull().alias("region_ok"),
    )


def attach_boundaries(seats: DataFrame, boundary: DataFrame) -> DataFrame:
    """Seats and boundary attributes by name; ``match_status`` tells both / seat_only / boundary_only."""
    shapes = boundary.select("name", "info_id", F.col("region").alias("boundary_region"), F.lit(1).alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), "seat_only").when(F.col("_s").isNull(), "boundary_only").otherwise("both")
    )
    return (
        seats.withColumn("_s", F.lit(1))
        .join(shapes, "name", "full_outer")
        .withColumn("match_status", status)
        .drop("_b", "_s")
    )


def with_labels(df: DataFrame, labels: DataFrame, code: str, label: str = "label") -> DataFrame:
    """Adds ``<code>_label`` from a dimension whose first column is the code."""
    key = labels.columns[0]
    names = labels.select(F.col(key).alias(code), F.col(label).alias(f"{code}_label"))
    return df.join(names, code, "left")


def normalise(df: DataFrame, keys: Sequence[str], col: str, total: float = 1.0) -> DataFrame:
    """Clips negatives, then scales ``col`` to sum to ``total`` in every group.

    Groups are seats or regions and hold one row per party.
    """
    clipped = F.greatest(F.col(col), F.lit(0.0))
    group_sum = F.sum(clipped).over(Window.partitionBy(*keys))
    return df.withColumn(col, F.try_divide(clipped * F.lit(total), group_sum))
