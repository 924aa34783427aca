"""Stored tables: results bucketed by seat, partitions that are replaced one by one, and facts that are cleaned once."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import clean_facts
from .inline import inline_table

# Eras and the timeframes of their pages.
ERA_TIMEFRAMES = [("AD", "year"), ("BC", "year"), ("BC", "decade"), ("BC", "century")]


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes ``df`` in folders of ``by``; only folders that it has rows for are replaced, the others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_rows(df: DataFrame, path: str, by: Sequence[str], keys: Sequence[str]) -> None:
    """Adds ``df`` to the table, in place of its rows with the same ``keys``; only folders that ``df`` has rows for are read.

    The folders are replaced when the job commits, so a failed job leaves the table as it was.
    """
    spark = df.sparkSession
    touched = F.broadcast(df.select(*by).distinct())  # a row for each folder
    kept = spark.read.schema(df.schema).parquet(path).join(touched, list(by), "left_semi")
    kept = kept.join(df.select(*by, *keys).distinct(), [*by, *keys], "left_anti")
    replace_partitions(kept.select(*df.columns).unionByName(df), path, by)


def save_results(result: DataFrame, table: str, buckets: int | None = None) -> None:
    """Results as a table with a partition for each election, bucketed by seat and sorted by seat and party.

    The rows of a seat are in the same bucket of each election, so what groups, ranks or compares by seat needs no shuffle.
    """
    spark = result.sparkSession
    count = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    writer = result.repartition(count, "seat").write.mode("overwrite").partitionBy("election_id")
    writer.bucketBy(count, "seat").sortBy("seat", "party_ord").format("parquet").saveAsTable(table)


def load_results(spark: SparkSession, table: str, elections: Sequence[str] | None = None) -> DataFrame:
    """Saved results; ``elections`` prunes partitions."""
    rows = spark.table(table).select("election_id", "seat", "party", "votes", "party_ord")
    return rows if elections is None else rows.where(F.col("election_id").isin(list(elections)))


def page_digest(*parts: str) -> Column:
    """What tells a page's contents from others."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def add_cleaned_facts(facts: DataFrame, path: str, window: int = 100) -> dict[str, int]:
    """Cleans the facts of pages that the table at ``path`` does not hold yet, and adds them.

    ``facts``: digest (of the fact's page), fact_id, year, era, timeframe_type, event. A page whose contents change has a
    new digest and is cleaned anew. Facts are written first and their digests after them, under the same batch; only
    batches with digests are ever read, so a job that dies half-way has added nothing, and running one twice adds nothing.
    Gives the counts of raw and kept facts by era and timeframe, observed while writing.
    """
    spark = facts.sparkSession
    batch = uuid.uuid4().hex
    fresh = facts
    if _exists(spark, f"{path}/pages"):
        fresh = facts.join(spark.read.parquet(f"{path}/pages").select("digest").distinct(), "digest", "left_anti")
    cleaned = clean_facts(fresh, window)
    seen = Observation()
    cells = []
    for era, timeframe in ERA_TIMEFRAMES:
        here = (F.col("era") == era) & (F.col("timeframe_type") == timeframe)
        cells += [F.count_if(here).alias(f"{era}_{timeframe}_raw"), F.count_if(here & F.col("kept")).alias(f"{era}_{timeframe}_kept")]
    folder = f"{path}/facts/batch={batch}"
    cleaned.observe(seen, *cells).write.parquet(folder)
    added = spark.read.schema(cleaned.schema).parquet(folder)
    added.select("digest").distinct().write.parquet(f"{path}/pages/batch={batch}")
    return seen.get


def cleaned_facts(spark: SparkSession, path: str, digests: DataFrame | None = None) -> DataFrame:
    """The cleaned facts (with ``cleaned`` and ``kept``), of all pages or of those with ``digests``."""
    batches = [r.batch for r in spark.read.parquet(f"{path}/pages").select("batch").distinct().collect()]  # one for each run
    rows = spark.read.parquet(f"{path}/facts").where(F.col("batch").isin(batches)).drop("batch")
    return rows if digests is None else rows.join(digests.select("digest").distinct(), "digest", "left_semi")


def observed_report(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """Raw, kept and filtered facts by era and timeframe from what ``add_cleaned_facts`` observed."""
    found = [(e, t, counts[f"{e}_{t}_raw"], counts[f"{e}_{t}_kept"]) for e, t in ERA_TIMEFRAMES if counts[f"{e}_{t}_raw"]]
    columns = {"era": "string", "timeframe_type": "string", "n_raw": "bigint", "n_kept": "bigint"}
    rows = inline_table(spark, columns, found)
    kept = F.lit(100.0) * F.col("n_kept") / F.col("n_raw")
    return rows.withColumns({"n_filtered": F.col("n_raw") - F.col("n_kept"), "kept_pct": kept})


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
