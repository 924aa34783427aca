"""Parties that do not stand: marking them and handing their votes on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from .project import _best, _lead
from .results import ELECTION
from .spread import spread_join

NOT_VOTING = "not_voting"


def mark_standing(
    result: DataFrame, candidates: DataFrame, parties: Sequence[str] = ("ukip", "green"), keys: Sequence[str] = ()
) -> DataFrame:
    """Adds ``standing``: 0 where one of ``parties`` has no row in the candidate list, else NULL."""
    listed = candidates.select(*keys, "seat", "party").distinct().withColumn("_listed", F.lit(True))
    absent = F.col("party").isin(list(parties)) & F.col("_listed").isNull()
    return (
        result.join(listed, [*keys, "seat", "party"], "left")
        .withColumn("standing", F.when(absent, F.lit(0)))
        .drop("_listed")
    )


def validate_rules(rules: DataFrame, keys: Sequence[str] = ("scenario_id", "election_id")) -> tuple[DataFrame, DataFrame]:
    """Checks transfer rules; returns (active rules with ``not_voting``, rejected sources).

    Percents are cut to whole numbers, malformed ones are 0. A source that gives away
    more than 100 percent is rejected; one that gives away nothing is inactive.
    """
    source = [*keys, "party_from"]
    whole = F.coalesce(F.col("pct").cast("string").try_cast("double").cast("int"), F.lit(0))
    clean = rules.withColumn("pct", whole)
    left_over = (F.lit(100) - F.sum("pct")).cast("int")
    per_source = F.lit(100) - F.sum("pct").over(Window.partitionBy(*source))  # one row per receiver
    active = clean.withColumn(NOT_VOTING, per_source.cast("int")).where(
        (F.col(NOT_VOTING) >= 0) & (F.col(NOT_VOTING) != 100)
    )
    rejected = clean.groupBy(*source).agg(left_over.alias(NOT_VOTING)).where(F.col(NOT_VOTING) < 0)
    return active, rejected


def _pack_rules(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    per_source = rules.groupBy(*keys, "ord", "party_from", NOT_VOTING).agg(
        F.map_from_entries(F.collect_list(F.struct("party_to", F.col("pct").cast("double").alias("pct")))).alias("gives")
    )
    source = F.struct("ord", "party_from", F.col(NOT_VOTING).cast("double").alias(NOT_VOTING), "gives")
    in_order = F.array_sort(F.collect_list(source), lambda a, b: F.signum(a["ord"] - b["ord"]).cast("int"))
    return per_source.groupBy(*keys).agg(in_order.alias("sources"))


def redistribute(
    result: DataFrame,
    rules: DataFrame,
    keys: Sequence[str] = ELECTION,
    rule_keys: Sequence[str] = ("scenario_id", "election_id"),
) -> DataFrame:
    """Votes of parties that stood down, handed to the parties their voters move to, as packed seats.

    ``result``: keys, seat, party, party_ord, votes, standing. ``rules``: rule_keys,
    ord, party_from, party_to, pct, not_voting. The sources of a scenario are worked
    off in ``ord`` order, with rounding after each, as a fold over the parties of one
    seat row. A scenario applies to the election its rules name, through the keys the
    two sides share; elections without rules are returned as they are.
    """
    shared = [k for k in rule_keys if k in keys]
    if not shared:
        raise ValueError("rules and results must share a key, for example election_id")
    packed = result.groupBy(*keys, "seat").agg(
        F.sum("votes").cast("double").alias("turnout"),
        F.sort_array(
            F.collect_list(
                F.struct("party_ord", "party", F.col("votes").cast("double").alias("votes"),
                         F.coalesce(F.col("standing") == 0, F.lit(False)).alias("absent"))
            )
        ).alias("ballots"),
    )
    # elections are few and hot: their seats are spread, one row of rules for each scenario meets each part
    rows = spread_join(packed, _pack_rules(rules, rule_keys), shared, ["seat"], "left")

    def hand_on(state: Column, source: Column) -> Column:
        leaving = F.filter(state["parties"], lambda p: p["absent"] & (p["party"] == source["party_from"]))

        def after(gone: Column) -> Column:
            def receive(p: Column) -> Column:
                share = F.try_element_at(source["gives"], p["party"])
                more = half_up(p["votes"] + share * gone["votes"] / F.lit(100.0)).cast("double")
                return F.struct(
                    p["party_ord"].alias("party_ord"), p["party"].alias("party"),
                    F.coalesce(more, p["votes"]).alias("votes"), p["absent"].alias("absent"),
                )

            stayed = F.filter(state["parties"], lambda p: p["party"] != source["party_from"])
            left = half_up(state["turnout"] - gone["votes"] * source[NOT_VOTING] / F.lit(100.0)).cast("double")
            return F.struct(F.transform(stayed, receive).alias("parties"), left.alias("turnout"))

        # a list of the one party that leaves, or of none: its votes are looked up once
        return F.coalesce(F.try_element_at(F.transform(leaving, after), F.lit(1)), state)

    start = F.struct(F.col("ballots").alias("parties"), F.col("turnout").alias("turnout"))
    done = F.when(F.col("sources").isNull(), start).otherwise(F.aggregate(F.col("sources"), start, hand_on))
    rows = rows.withColumn("done", done)
    parties = F.transform(
        F.col("done.parties"),
        lambda p: F.struct(p["party_ord"].alias("party_ord"), p["party"].alias("party"), p["votes"].alias("votes")),
    )
    rows = rows.withColumn("parties", parties)
    extra = [k for k in rule_keys if k not in keys]
    return rows.select(
        *keys, *extra, "seat", F.col("done.turnout").alias("turnout"), _best(F.col("parties"), "votes").alias("winner"),
        _lead(F.col("parties"), "votes").alias("majority"), "parties",
    )
