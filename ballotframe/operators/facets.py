"""Faceted card catalogue: play mode, facet selections, mechanic, sorting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dims import CARD_LABELS, CARD_RACES, COST_BUCKETS, STANDARD_SETS

# Default selections: every value of every facet, standard mode only.
DEFAULT_SELECTIONS: dict[str, list[str]] = {
    "mode": ["standard"],
    "card_class": list(CARD_LABELS["class"]),
    "type": list(CARD_LABELS["type"]),
    "rarity": list(CARD_LABELS["rarity"]),
    "race": CARD_RACES,
    "cost": COST_BUCKETS,
}

# Column that holds the facet's value, where it is not the facet's own name.
_FACET_COLUMN = {"cost": "cost_bucket"}


def with_mode(cards: DataFrame, standard_sets: Sequence[str] = tuple(STANDARD_SETS)) -> DataFrame:
    """Adds ``mode`` (standard / wild) from the set and ``cost_bucket`` (0..6, 7plus)."""
    standard = F.coalesce(F.col("card_set").isin(list(standard_sets)), F.lit(False))
    return cards.withColumn("mode", F.when(standard, "standard").otherwise("wild")).withColumn(
        "cost_bucket", F.when(F.col("cost") >= 7, "7plus").otherwise(F.col("cost").cast("string"))
    )


def toggle(selections: Mapping[str, Sequence[str]], facet: str, value: str) -> dict[str, list[str]]:
    """Selections with one value of one facet switched on or off."""
    chosen = list(selections.get(facet, []))
    changed = [v for v in chosen if v != value] if value in chosen else [*chosen, value]
    return {**{k: list(v) for k, v in selections.items()}, facet: changed}


def select_all(on: bool) -> dict[str, list[str]]:
    """Everything selected in every facet and both modes, or nothing."""
    everything = {**DEFAULT_SELECTIONS, "mode": ["standard", "wild"]}
    return {facet: list(values) if on else [] for facet, values in everything.items()}


def facet_filter(
    cards: DataFrame, selections: Mapping[str, Sequence[str]], mechanic: str | None = None
) -> DataFrame:
    """Cards whose value lies in the selected set of every facet given, and that have the mechanic."""
    keep = F.lit(True)
    for facet, values in selections.items():
        keep = keep & F.col(_FACET_COLUMN.get(facet, facet)).isin(list(values))
    if mechanic is not None:
        keep = keep & F.array_contains("mechanics", mechanic)
    return cards.where(keep)


def facet_count(cards: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return cards.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cards"))
