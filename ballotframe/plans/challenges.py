"""Facts to guessing challenges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.facts import GROUP, fact_groups, kept_facts, one_per_period, sample_per_group


def challenges(
    facts: DataFrame, min_facts: int = 3, n: int = 5, seed: int = 0, window: int = 100
) -> DataFrame:
    """(year, era, timeframe_type, bucket_start, n_facts, facts): up to ``n`` facts per challenge.

    ``facts``: fact_id, year, era, timeframe_type, event. Counting and drawing are two
    passes, each of which shrinks its rows before the shuffle, so no group of facts is
    ever gathered: one passes on counts, the other at most ``n`` facts per task and group.
    Hand in facts already cleaned (with ``cleaned`` and ``kept``) to clean only once.
    """
    kept = kept_facts(facts, window)
    periods = one_per_period(
        fact_groups(kept, min_facts, "cleaned").withColumn("group_year", F.col("year"))
    )
    drawn = sample_per_group(kept, GROUP, n, seed).select(
        F.col("year").alias("group_year"), "era", "timeframe_type", "draw_no", "cleaned"
    )
    lists = drawn.groupBy("group_year", "era", "timeframe_type").agg(
        F.sort_array(F.collect_list(F.struct("draw_no", "cleaned"))).alias("drawn")
    )
    return periods.join(lists, ["group_year", "era", "timeframe_type"]).select(
        "year", "era", "timeframe_type", "bucket_start", "n_facts",
        F.transform("drawn", lambda d: d["cleaned"]).alias("facts"),
    )
