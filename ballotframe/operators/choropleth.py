"""Map colour intensity of one party's share, or of its change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAP = 0.6


def _values(pair: DataFrame, party: str, kind: str) -> DataFrame:
    own = F.col("party") == party
    rows = pair.groupBy("view_id", "seat").agg(
        F.sum("votes").alias("turnout"),
        F.sum("prev_votes").alias("prev_turnout"),
        F.max(F.when(own, F.col("votes"))).alias("votes"),
        F.max(F.when(own, F.col("prev_votes"))).alias("prev_votes"),
    ).where(F.col("turnout").isNotNull())
    share = F.coalesce(F.try_divide("votes", "turnout"), F.lit(0.0))
    if kind == "share":
        return rows.select("view_id", "seat", share.alias("value"))
    before = F.coalesce(F.try_divide("prev_votes", "prev_turnout"), F.lit(0.0))
    return rows.select("view_id", "seat", (share - before).alias("value"))


def _flagged(pair: DataFrame, party: str, kind: str, filtered: DataFrame | None) -> DataFrame:
    values = _values(pair, party, kind)
    if filtered is None:
        return values.withColumn("filtered", F.lit(True))
    flags = filtered.select("view_id", "seat", "filtered")
    return values.join(flags, ["view_id", "seat"], "left").withColumn(
        "filtered", F.coalesce("filtered", F.lit(False))
    )


def choropleth_max(pair: DataFrame, party: str, kind: str = "share", filtered: DataFrame | None = None) -> DataFrame:
    """Largest share or absolute change among the filtered seats of each view, at most 0.6."""
    rows = _flagged(pair, party, kind, filtered).where("filtered")
    return rows.groupBy("view_id").agg(F.least(F.max(F.abs("value")), F.lit(CAP)).alias("max_value"))


def choropleth(pair: DataFrame, party: str, kind: str = "share", filtered: DataFrame | None = None) -> DataFrame:
    """Intensity -1..1 per seat: value over the view's maximum; 0 for filtered-out seats.

    ``kind`` is ``share`` or ``change``; ``filtered`` holds (view_id, seat, filtered).
    """
    rows = _flagged(pair, party, kind, filtered)
    top = rows.where("filtered").groupBy("view_id").agg(
        F.least(F.max(F.abs("value")), F.lit(CAP)).alias("max_value")
    )
    scaled = F.coalesce(F.try_divide("value", "max_value"), F.lit(0.0))
    intensity = F.when(F.col("filtered"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), scaled))).otherwise(F.lit(0.0))
    # one row for each view of the registry
    return rows.join(F.broadcast(top), "view_id", "left").select(
        "view_id", "seat", "value", "max_value", intensity.alias("intensity"),
        F.when(intensity < 0, "minus").otherwise("plus").alias("sign_class"),
    )
