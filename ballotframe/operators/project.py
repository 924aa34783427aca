"""Seat projections: regional change from polls, and user scenarios.

Seats are packed to one row holding an array with one entry per party, so
flooring, normalising, rounding and picking the winner are computed inside the
row: the votes are shuffled once, to build the row, and never again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import unpack
from ..functions.numeric import half_even, half_up, pct, truncate
from ..storage import stored
from .results import ELECTION, VIEW
from .spread import spread_join

SCENARIO = ("scenario_id", "view_id")

FLOOR = 0.1  # a party keeps at least this part of its old share


def party_rows(packed: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Long form of packed seats: one row per seat and party."""
    kept = [c for c in packed.columns if c != "parties" and c not in drop]
    return unpack(packed, kept, F.inline_outer("parties"), "party")


def pack_seats(result: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per seat: turnout and its parties as an array (at most one entry per party)."""
    return result.groupBy(*keys, "seat", *by).agg(
        F.sum("votes").alias("turnout"),
        F.sort_array(F.collect_list(F.struct("party_ord", "party", "votes"))).alias("ballots"),
    )


def _shared(parties: Column, part: Callable[[Column], Column], build: Callable[[Column, Column], Column]) -> Column:
    """``build(party, total)`` for every party, where total is the sum of ``part`` over all of them.

    The total is bound by the aggregate itself, so it is computed once per row; as a
    column of its own it could be moved into the loop over the parties.
    """
    return F.aggregate(
        F.transform(parties, part), F.lit(0.0), lambda acc, v: acc + v,
        lambda total: F.transform(parties, lambda p: build(p, total)),
    )


def _best(parties: Column, score: str) -> Column:
    """Party with the highest positive score; the earlier party wins a tie."""
    scored = F.transform(
        parties, lambda p: F.struct(p[score].alias("score"), (-p["party_ord"]).alias("neg_ord"), p["party"].alias("party"))
    )
    top = F.array_max(scored)
    return F.when(top["score"] > 0, top["party"])


def _lead(parties: Column, field: str) -> Column:
    """Highest minus second highest value (a lone party leads by all of it)."""
    ordered = F.sort_array(F.transform(parties, lambda p: p[field]), asc=False)
    second = F.try_element_at(ordered, F.lit(2))
    return F.try_element_at(ordered, F.lit(1)) - F.coalesce(second, second * 0, F.lit(0))


def regional_change(estimates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Normalised new share, and its change from the old share where that was not 0.

    ``estimates``: keys, region, party, old_share, estimate, had_polls. Regions and
    parties without polls keep their old share: change 0.
    """
    region = Window.partitionBy(*keys, "region")  # one row per party
    clipped = F.greatest(F.col("estimate"), F.lit(0.0))
    new = F.when(F.col("had_polls"), F.try_divide(clipped, F.sum(clipped).over(region)))
    existed = F.col("old_share") != 0
    rows = estimates.withColumn("new_share", F.coalesce(new, "old_share"))
    return rows.select(
        *keys, "region", "party", "old_share", "new_share", "had_polls",
        F.when(existed, F.col("new_share") - F.col("old_share")).alias("change"),
        F.when(existed, F.try_divide("new_share", "old_share")).alias("relative"),
    )


def pack_changes(change: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per region with the changes of its parties, as an array and for lookup."""
    packed = change.where(F.col("change").isNotNull()).groupBy(*keys, "region").agg(
        F.sort_array(F.collect_list(F.struct("party", "change"))).alias("changes")
    )
    return packed.withColumn("swing", F.map_from_entries("changes"))


def project(
    result: DataFrame,
    seats: DataFrame,
    change: DataFrame,
    keys: Sequence[str] = ELECTION,
    change_keys: Sequence[str] = (),
    always_present: Sequence[str] = ("other",),
) -> DataFrame:
    """Uniform regional swing on every seat, as packed seats.

    A party's new share is old share + change, 0 where the region has no change for
    it, but never below a tenth of the old share; an old share of 0 stays 0; a party
    new to the seat gets the change if that is positive. Shares are normalised and
    turned into votes, halves rounded to even. ``winner`` is the leader before floor
    and normalising among the parties of the seat, ``winner_final`` the leader by
    projected votes. ``always_present`` parties count as parties of every seat.
    """
    packed = pack_seats(result, keys).join(seats.select("seat", "region", "electorate"), "seat")
    shared = [k for k in change_keys if k in keys]
    joined = packed.join(pack_changes(change, change_keys), [*shared, "region"], "left").withColumn(
        "changes", F.coalesce("changes", F.expr("cast(array() as array<struct<party:string,change:double>>)"))
    ).withColumn("swing", F.coalesce("swing", F.expr("cast(map() as map<string,double>)")))

    def swing_of(party: Column) -> Column:
        return F.try_element_at(F.col("swing"), party)

    def standing(b: Column) -> Column:
        share = F.try_divide(b["votes"].cast("double"), F.col("turnout"))
        raw = F.coalesce(swing_of(b["party"]) + share, F.lit(0.0))
        floored = F.when(share == 0, F.lit(0.0)).otherwise(F.greatest(raw, F.lit(FLOOR) * share))
        return F.struct(
            b["party_ord"].alias("party_ord"), b["party"].alias("party"), b["votes"].cast("double").alias("old_votes"),
            raw.alias("raw"), floored.alias("share"),
        )

    in_seat = F.transform(F.col("ballots"), lambda b: b["party"])
    new_parties = F.transform(
        F.filter(
            F.col("changes"),
            lambda c: ~F.array_contains(in_seat, c["party"]) & ~c["party"].isin(list(always_present)),
        ),
        lambda c, i: F.struct(
            (F.lit(1000) + i).alias("party_ord"), c["party"].alias("party"), F.lit(0.0).alias("old_votes"),
            F.lit(0.0).alias("raw"), F.greatest(c["change"], F.lit(0.0)).alias("share"),
        ),
    )
    stood = joined.withColumn("stood", F.transform(F.col("ballots"), standing))
    shares = stood.withColumn("winner", _best(F.col("stood"), "raw")).withColumn(
        "drawn", F.concat(F.col("stood"), new_parties)
    )

    def to_votes(p: Column, total: Column) -> Column:
        return F.struct(
            p["party_ord"].alias("party_ord"), p["party"].alias("party"), p["old_votes"].alias("old_votes"),
            half_even(F.try_divide(p["share"], total) * F.col("turnout")).alias("votes"),
        )

    final = shares.withColumn("parties", _shared(F.col("drawn"), lambda p: p["share"], to_votes))
    return final.select(
        *keys, *[k for k in change_keys if k not in keys], "seat", "region", "electorate", "turnout", "winner",
        _best(F.col("parties"), "votes").alias("winner_final"),
        _lead(F.col("parties"), "votes").alias("majority"), "parties",
    )


def validate_inputs(inputs: DataFrame, keys: Sequence[str] = SCENARIO) -> tuple[DataFrame, DataFrame]:
    """Cleans user percents; returns (accepted rows, rejected groups).

    Blank and negative values become 0 and two decimals are kept. Groups that are all
    zero are dropped; groups adding up to more than 100 are rejected. Accepted rows
    carry ``other_pct``, what the listed parties leave over.
    """
    group = [*keys, "region_group"]
    hundredths = half_up(F.coalesce(F.greatest(F.col("pct"), F.lit(0.0)), F.lit(0.0)) * 100.0)
    clean = inputs.withColumn("hundredths", hundredths)
    per_group = Window.partitionBy(*group)  # one row per party
    summed = clean.select(
        *group, "party", "hundredths", F.sum("hundredths").over(per_group).alias("sum_h"),
        F.max("hundredths").over(per_group).alias("max_h"),
    )
    accepted = summed.where("max_h > 0 and sum_h <= 10000").select(
        *group, "party", (F.col("hundredths") / 100.0).alias("pct"),
        ((F.lit(10000) - F.col("sum_h")) / 100.0).alias("other_pct"),
    )
    sums = clean.groupBy(*group).agg(F.sum("hundredths").alias("sum_h"))
    rejected = sums.where("sum_h > 10000").select(*group, (F.col("sum_h") / 100.0).alias("sum_pct"))
    return accepted, rejected


def scenario_change(
    accepted: DataFrame, shares: DataFrame, keys: Sequence[str] = SCENARIO, share_keys: Sequence[str] = VIEW,
    remainder: str = "other",
) -> DataFrame:
    """Change of every counted party per scenario and region, as packed arrays.

    ``accepted``: keys, region_group, party, pct, other_pct. ``shares``: share_keys,
    region_group, region, party, overall_pct, region_pct (all parties of the group).
    Parties without an input count as 0, ``remainder`` takes what is left of 100. New
    regional percent = regional + (input - overall), clipped at 0, normalised to 100.
    """
    asked = accepted.groupBy(*keys, "region_group").agg(
        F.map_from_entries(F.collect_list(F.struct("party", "pct"))).alias("wanted"), F.max("other_pct").alias("other_pct")
    )
    known = shares.groupBy(*share_keys, "region_group", "region").agg(
        F.sort_array(F.collect_list(F.struct("party", "region_pct", "overall_pct"))).alias("known")
    )

    def moved(k: Column) -> Column:
        wish = F.when(k["party"] == remainder, F.col("other_pct")).otherwise(
            F.coalesce(F.try_element_at(F.col("wanted"), k["party"]), F.lit(0.0))
        )
        new = F.greatest(k["region_pct"] + (wish - k["overall_pct"]), F.lit(0.0))
        return F.struct(k["party"].alias("party"), k["region_pct"].alias("old"), new.alias("new"))

    by = [k for k in keys if k not in share_keys]
    joined = spread_join(asked, known, [*share_keys, "region_group"], by)
    rows = joined.withColumn("moved", F.transform(F.col("known"), moved))

    def changed(m: Column, total: Column) -> Column:
        new = F.try_divide(m["new"], total / F.lit(100.0))
        return F.struct(m["party"].alias("party"), (new - m["old"]).alias("change"))

    return rows.select(
        *keys, "region_group", "region", _shared(F.col("moved"), lambda m: m["new"], changed).alias("changes")
    )


def project_inputs(pair: DataFrame, seats: DataFrame, changes: DataFrame, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """User-set swing on every seat of the regions a scenario covers, as packed seats.

    ``pair``: election pair, others already folded. ``changes``: keys, region, changes.
    New percent = previous percent + change, at least a tenth of the previous percent,
    normalised to 100; votes use the current turnout. Only parties with votes are kept.
    """
    stood_before = F.col("prev_votes").isNotNull()
    packed = (
        pair.groupBy(*VIEW, "seat")
        .agg(
            F.sum("votes").alias("turnout"),
            F.sum("prev_votes").alias("prev_turnout"),
            F.map_from_entries(
                F.collect_list(F.when(stood_before, F.struct("party", F.struct("party_ord", "prev_votes"))))
            ).alias("ballots"),
        )
        .where(F.col("turnout").isNotNull())
        .join(seats.select("seat", "region", "electorate"), "seat")
    )
    by = [k for k in keys if k not in VIEW]
    rows = spread_join(changes, packed, [*VIEW, "region"], by)

    def moved(c: Column, i: Column) -> Column:
        held = F.try_element_at(F.col("ballots"), c["party"])
        was = F.coalesce(pct(held["prev_votes"], F.col("prev_turnout")), F.lit(0.0))
        return F.struct(
            F.coalesce(held["party_ord"], F.lit(1000) + i).alias("party_ord"), c["party"].alias("party"),
            F.greatest(was + c["change"], F.lit(FLOOR) * was).alias("pct"),
        )

    rows = rows.withColumn("moved", F.transform(F.col("changes"), moved))

    def scaled(m: Column, total: Column) -> Column:
        return F.struct(
            m["party_ord"].alias("party_ord"), m["party"].alias("party"),
            F.try_divide(m["pct"], total / F.lit(100.0)).alias("pct"),
        )

    rows = rows.withColumn("scaled", _shared(F.col("moved"), lambda m: m["pct"], scaled))
    parties = F.transform(
        F.filter(F.col("scaled"), lambda p: p["pct"] > 0),
        lambda p: F.struct(
            p["party_ord"].alias("party_ord"), p["party"].alias("party"),
            (p["pct"] * F.col("turnout") / F.lit(100.0)).alias("votes"),
        ),
    )
    return rows.select(
        *keys, "seat", "region", "electorate", "turnout", _best(F.col("scaled"), "pct").alias("winner"),
        truncate(_lead(F.col("scaled"), "pct") * F.col("turnout") / F.lit(100.0)).alias("majority"),
        parties.alias("parties"),
    )


def unchanged_seats(
    pair: DataFrame, seats: DataFrame, changes: DataFrame, scenarios: DataFrame, keys: Sequence[str] = SCENARIO
) -> DataFrame:
    """Seats of the regions a scenario leaves alone, with their current votes, as packed seats.

    ``scenarios``: one row of keys per scenario; each view's regions are matched to its
    scenarios first, then the regions a scenario covers are taken out.
    """
    current = pair.where(F.col("votes").isNotNull())
    packed = stored(pack_seats(current, VIEW).join(seats.select("seat", "region", "electorate"), "seat"))
    placed = packed.select(*VIEW, "region").distinct()
    left_alone = scenarios.join(placed, list(VIEW)).join(
        changes.select(*keys, "region").distinct(), [*keys, "region"], "left_anti"
    )
    parties = F.transform(
        F.col("ballots"),
        lambda b: F.struct(
            b["party_ord"].alias("party_ord"), b["party"].alias("party"), b["votes"].cast("double").alias("votes")
        ),
    )
    by = [k for k in keys if k not in VIEW]
    return spread_join(left_alone, packed, [*VIEW, "region"], by).withColumn("parties", parties).select(
        *keys, "seat", "region", "electorate", "turnout", _best(F.col("parties"), "votes").alias("winner"),
        truncate(_lead(F.col("parties"), "votes")).alias("majority"), "parties",
    )


def packed_results(result: DataFrame, seats: DataFrame, keys: Sequence[str] = ELECTION) -> DataFrame:
    """Actual results in the packed form of the projections, ready to be written as documents.

    Where the result has ``standing`` and ``candidate``, the parties keep them.
    """
    kept = [c for c in ("standing", "candidate") if c in result.columns]
    packed = result.groupBy(*keys, "seat").agg(
        F.sum("votes").alias("turnout"), F.sort_array(F.collect_list(F.struct("party_ord", "party", "votes", *kept))).alias("parties")
    )
    return packed.join(seats.select("seat", "region", "electorate"), "seat").select(
        *keys, "seat", "region", "electorate", "turnout", _best(F.col("parties"), "votes").alias("winner"),
        _lead(F.col("parties"), "votes").alias("majority"), "parties",
    )
