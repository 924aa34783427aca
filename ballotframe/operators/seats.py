"""Seat lists and single-seat profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import half_up, pct
from ..sources.dims import BUCKET_OF, BUCKETS
from .results import compare


def bucket_of(party: Column, mapping: Mapping[str, str] = BUCKET_OF) -> Column:
    """Display bucket of a party; NULL for a party that has none."""
    entries = [item for pair in mapping.items() for item in (F.lit(pair[0]), F.lit(pair[1]))]
    return F.try_element_at(F.create_map(*entries).cast(T.MapType(T.StringType(), T.StringType())), party)


def _bucketed(pair: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    seat = Window.partitionBy("view_id", "seat")
    return pair.select(
        "view_id", "seat", bucket_of(F.col("party"), mapping).alias("bucket"), "votes", "prev_votes",
        F.sum("votes").over(seat).alias("turnout"), F.sum("prev_votes").over(seat).alias("prev_turnout"),
    ).where(F.col("turnout").isNotNull())


def extended_seats(
    pair: DataFrame, mapping: Mapping[str, str] = BUCKET_OF, buckets: Sequence[str] = tuple(BUCKETS)
) -> DataFrame:
    """One row per seat with the rounded share of every display bucket; absent stays NULL."""
    shares = (
        _bucketed(pair, mapping)
        .groupBy("view_id", "seat", "turnout")
        .pivot("bucket", list(buckets))
        .agg(F.sum("votes"))
    )
    return shares.select(
        "view_id", "seat", *[half_up(pct(F.col(b), F.col("turnout")), 2).alias(f"{b}_pct") for b in buckets]
    )


def with_direction(
    pair: DataFrame, mapping: Mapping[str, str] = BUCKET_OF, buckets: Sequence[str] = tuple(BUCKETS)
) -> DataFrame:
    """Rise (1), fall (-1) or equal (0) of every display bucket, compared at two decimals."""
    rows = (
        _bucketed(pair, mapping)
        .where(F.col("bucket").isin(list(buckets)))
        .groupBy("view_id", "seat", "bucket", "turnout", "prev_turnout")
        .agg(F.sum("votes").alias("votes"), F.sum("prev_votes").alias("prev_votes"))
    )
    now = half_up(F.coalesce(pct(F.col("votes"), F.col("turnout")), F.lit(0.0)), 2)
    before = half_up(F.coalesce(pct(F.col("prev_votes"), F.col("prev_turnout")), F.lit(0.0)), 2)
    return rows.select(
        "view_id", "seat", "bucket", now.alias("share_pct"), before.alias("prev_share_pct"),
        F.when(now > before, 1).when(now < before, -1).otherwise(0).alias("direction"),
    )


def seat_profile(pair: DataFrame, min_share: float | None = None) -> DataFrame:
    """Parties of a seat ranked by share, with rounded share, previous share and change."""
    share = half_up(F.col("share_pct"), 2)
    prev_share = half_up(F.col("prev_share_pct"), 2)
    rows = compare(pair).where(F.col("votes") > 0).select(
        "view_id", "seat", "party", "party_ord", "votes", share.alias("share_pct"), prev_share.alias("prev_share_pct"),
        F.when(F.col("party").isin("other", "others"), F.lit(0.0))
        .otherwise(half_up(share - prev_share, 2)).alias("change_pct"),
    )
    seat = Window.partitionBy("view_id", "seat").orderBy(F.desc("share_pct"), F.asc("party_ord"))
    ranked = rows.withColumn("place", F.row_number().over(seat)).drop("party_ord")
    return ranked if min_share is None else ranked.where(F.col("share_pct") > min_share)
