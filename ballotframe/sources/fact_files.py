"""Fact table, challenge files and card catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import replace_partitions

CARD_SCHEMA = (
    "name string, cardClass string, type string, rarity string, race string, `set` string, "
    "cost int, costStr string, mechanics array<string>, url string"
)


def write_facts(facts: DataFrame, path: str) -> None:
    """Fact table in Parquet, one folder per era and century; folders that ``facts`` has no rows for stay as they are."""
    century = F.floor((F.col("year") - 1) / 100).cast("int")
    replace_partitions(facts.withColumn("century", century), path, ["era", "century"])


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("century")


def write_challenges(challenges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON line per challenge: y, e, t and the facts f."""
    challenges.select(
        F.col("year").alias("y"), F.col("era").alias("e"), F.col("timeframe_type").alias("t"), F.col("facts").alias("f")
    ).write.mode(mode).json(path)


def read_cards(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Card catalogue with the column names the facet operators use; a missing race is ``''``."""
    cards = spark.read.schema(CARD_SCHEMA).json(path, multiLine=multi_line)
    return cards.select(
        "name", F.col("cardClass").alias("card_class"), "type", "rarity", F.coalesce("race", F.lit("")).alias("race"),
        F.col("set").alias("card_set"), "cost", F.coalesce("mechanics", F.array().cast("array<string>")).alias("mechanics"),
        "url",
    )
