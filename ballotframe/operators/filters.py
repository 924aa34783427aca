"""Seat filters, battlegrounds, seat search, saved views and stable sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import pct
from ..sources.dims import DEFAULT_VIEW, OWN_BASE_VIEW
from .results import ELECTION, top_party
from .spread import spread_join

_BUCKET_PCT = 5.0  # width of the majority buckets that saved views and seats are joined on
_LAST_BUCKET = 20


def seat_predicate(
    winner: str | Sequence[str] | None = None,
    region: str | Sequence[str] | None = None,
    majority: tuple[float, float] = (0.0, 100.0),
    by_election: bool = False,
    gains: bool = False,
) -> Column:
    """Conjunction of the criteria that are set; bounds are inclusive."""

    def one_of(column: str, wanted: str | Sequence[str]) -> Column:
        return F.col(column).isin([wanted] if isinstance(wanted, str) else list(wanted))

    keep = F.col("majority_pct").between(F.lit(float(majority[0])), F.lit(float(majority[1])))
    if winner is not None:
        keep = keep & one_of("winner", winner)
    if region is not None:
        keep = keep & one_of("region", region)
    if by_election:
        keep = keep & F.col("by_election").isNotNull()
    if gains:
        keep = keep & (F.col("winner") != F.col("prev_winner"))
    return F.coalesce(keep, F.lit(False))


def filter_seats(seats: DataFrame, mark: bool = False, **criteria) -> DataFrame:
    """Seats that meet every criterion, or all seats with a ``filtered`` flag."""
    keep = seat_predicate(**criteria)
    return seats.withColumn("filtered", keep) if mark else seats.where(keep)


def expand_region(df: DataFrame, groups: DataFrame, col: str = "region") -> DataFrame:
    """Rows named by a region group are repeated for each member; NULL means the whole country.

    ``groups``: region_group, region. A region that is no group stands for itself.
    """
    named = F.coalesce(F.nullif(F.col(col), F.lit("null")), F.lit("unitedkingdom"))
    members = groups.select(F.col("region_group").alias("_group"), F.col("region").alias("_member"))
    return (
        df.withColumn("_group", named)
        .join(members, "_group", "left")
        .withColumn(col, F.coalesce("_member", "_group"))
        .drop("_group", "_member")
    )


def battlegrounds(
    result: DataFrame,
    incumbent: str | None,
    challenger: str | None,
    lo: float = 0.0,
    hi: float = 10.0,
    keys: Sequence[str] = ELECTION,
    seats: DataFrame | None = None,
    region: str | Sequence[str] | None = None,
) -> DataFrame:
    """Seats the incumbent holds with a lead over the challenger between ``lo`` and ``hi`` percent.

    ``result`` is the base election: the previous one, or the current one for a view
    that is its own base. Without two different parties nothing is filtered.
    """
    grouped = result.groupBy(*keys, "seat").agg(
        top_party().alias("top"),
        F.sum("votes").alias("turnout"),
        F.max(F.when(F.col("party") == F.lit(challenger), F.col("votes"))).alias("challenger_votes"),
    )
    rows = grouped.select(
        *keys, "seat", "turnout", F.col("top.party").alias("incumbent"), F.col("top.votes").alias("incumbent_votes"),
        "challenger_votes", pct(F.col("top.votes") - F.col("challenger_votes"), F.col("turnout")).alias("lead_pct"),
    )
    if incumbent is not None and challenger is not None and incumbent != challenger:
        bounds = F.lit(max(float(lo), 0.0)), F.lit(min(float(hi), 100.0))
        rows = rows.where((F.col("incumbent") == incumbent) & F.col("lead_pct").between(*bounds))
    if region is not None and seats is not None:
        wanted = [region] if isinstance(region, str) else list(region)
        rows = rows.join(seats.where(F.col("region").isin(wanted)).select("seat"), "seat", "left_semi")
    return rows


def search_seats(seats: DataFrame, term: str) -> DataFrame:
    return seats.where(F.lower("name").contains(term.lower())).orderBy("name")


def stable_sort(df: DataFrame, col: str, ascending: bool, tie: str, blank_as_zero: bool = False) -> DataFrame:
    """Sort with an explicit tie key; blank numbers may sort as 0 while they stay NULL in the output."""
    key = F.coalesce(F.col(col), F.lit(0)) if blank_as_zero else F.col(col)
    return df.orderBy(key.asc() if ascending else key.desc(), F.col(tie).asc())


def link_parameter(url: Column, name: str) -> Column:
    """One decoded query parameter in lower case; NULL when absent or "null", which means no filter."""
    return F.nullif(F.lower(F.try_parse_url(url, F.lit("QUERY"), F.lit(name))), F.lit("null"))


def parse_links(links: DataFrame, default_view: str = DEFAULT_VIEW) -> DataFrame:
    """Filter specs from link parameters: (link_id, url) -> one spec row per link.

    A link that names no map means ``default_view``.
    Bounds that are no number fall back to 0, and to 100 for filters or 10 for battlegrounds.
    """
    url = F.col("url")

    def flag(name: str) -> Column:
        return F.coalesce(link_parameter(url, name).isin("yes", "true"), F.lit(False))

    def bound(name: str, default: Column) -> Column:
        return F.coalesce(link_parameter(url, name).try_cast("double"), default)

    challenger = link_parameter(url, "challenger")
    return links.select(
        "link_id",
        F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("map")), F.lit(default_view)).alias("view_id"),
        link_parameter(url, "incumbent").alias("incumbent"),
        challenger.alias("challenger"),
        link_parameter(url, "region").alias("region"),
        bound("majlow", F.lit(0.0)).alias("lo"),
        bound("majhigh", F.when(challenger.isNull(), 100.0).otherwise(10.0)).alias("hi"),
        flag("gains").alias("gains"),
        flag("byelection").alias("by_election"),
    )


def link_classes(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Specs that ask the same as one spec, whose ``link_id`` is a digest of what it asks, and (link_id, class_id).

    Matches of classes grow with what is asked, not with the number of links; joined to the second table they
    give each link's seats.
    """
    asked = [c for c in specs.columns if c != "link_id"]
    digest = F.sha2(F.to_json(F.struct(*asked)), 256)
    return specs.select(digest.alias("link_id"), *asked).distinct(), specs.select("link_id", digest.alias("class_id")).distinct()


def _bucket(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(_LAST_BUCKET), F.floor(value / _BUCKET_PCT).cast("int")))


def match_views(specs: DataFrame, seats: DataFrame, groups: DataFrame) -> DataFrame:
    """(link_id, seat) for every filter link and every seat it shows.

    Criteria that may be unset become ``*`` keys: each seat offers its own winner
    and region as well as ``*``, each spec asks for exactly one combination, and
    both sides carry the bucket of the majority. So the match is an equi-join;
    only the exact bounds and the flags are left to check on its rows. A spec
    without criteria is spread over all majority buckets, and links that ask the same
    are spread over many tasks.
    """
    asked = specs.where(F.col("challenger").isNull())
    everywhere = asked.where(F.col("region").isNull()).withColumn("region", F.lit("*"))
    placed = expand_region(asked.where(F.col("region").isNotNull()), groups.select(
        F.lower("region_group").alias("region_group"), F.lower("region").alias("region")))
    buckets = F.explode(F.sequence(_bucket(F.col("lo")), F.greatest(_bucket(F.col("lo")), _bucket(F.col("hi")))))
    keyed = placed.unionByName(everywhere).select(
        "link_id", "view_id", F.coalesce("incumbent", F.lit("*")).alias("k_winner"), F.col("region").alias("k_region"),
        buckets.alias("k_bucket"), "lo", "hi", "gains", "by_election",
    )
    offered = seats.where(F.col("majority_pct").isNotNull()).select(
        "view_id", "seat", "winner", "prev_winner", "by_election", "majority_pct",
        F.explode(F.array(F.lower("winner"), F.lit("*"))).alias("k_winner"),
        F.lower("region").alias("region"), _bucket(F.col("majority_pct")).alias("k_bucket"),
    ).withColumn("k_region", F.explode(F.array("region", F.lit("*")))).withColumnRenamed("by_election", "held_on")
    joined = spread_join(keyed, offered, ["view_id", "k_winner", "k_region", "k_bucket"], ["link_id"])
    return joined.where(
        F.col("majority_pct").between(F.col("lo"), F.col("hi"))
        & (~F.col("gains") | (F.col("winner") != F.col("prev_winner")))
        & (~F.col("by_election") | F.col("held_on").isNotNull())
    ).select("link_id", "view_id", "seat")


def match_battlegrounds(
    specs: DataFrame, pair: DataFrame, seats: DataFrame, groups: DataFrame, own_base: Sequence[str] = (OWN_BASE_VIEW,)
) -> DataFrame:
    """(link_id, seat) for every link that names an incumbent and a different challenger.

    Leads are those of the previous election; of the current one for views in ``own_base``.
    """
    asked = specs.where(F.col("challenger").isNotNull() & (F.col("challenger") != F.col("incumbent")))
    everywhere = asked.where(F.col("region").isNull()).withColumn("region", F.lit("*"))
    placed = expand_region(asked.where(F.col("region").isNotNull()), groups.select(
        F.lower("region_group").alias("region_group"), F.lower("region").alias("region")))
    keyed = placed.unionByName(everywhere).select(
        "link_id", "view_id", "incumbent", "challenger", F.col("region").alias("k_region"),
        F.greatest(F.col("lo"), F.lit(0.0)).alias("lo"), F.least(F.col("hi"), F.lit(100.0)).alias("hi"),
    )
    seat = Window.partitionBy("view_id", "seat")
    votes = F.when(F.col("view_id").isin(list(own_base)), F.col("votes")).otherwise(F.col("prev_votes"))
    leads = (
        pair.withColumn("base_votes", votes)
        .where(F.col("base_votes").isNotNull())
        .withColumn("top", top_party("base_votes").over(seat))
        .withColumn("turnout", F.sum("base_votes").over(seat))
        .select("view_id", "seat", F.lower("top.party").alias("incumbent"), F.lower("party").alias("challenger"),
                pct(F.col("top.votes") - F.col("base_votes"), F.col("turnout")).alias("lead_pct"))
        .join(seats.select("seat", F.lower("region").alias("region")), "seat")
        .withColumn("k_region", F.explode(F.array("region", F.lit("*"))))
    )
    return spread_join(keyed, leads, ["view_id", "incumbent", "challenger", "k_region"], ["link_id"]).where(
        F.col("lead_pct").between(F.col("lo"), F.col("hi"))
    ).select("link_id", "view_id", "seat")
