"""Poll-tracker documents: poll points and model points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import unpack

from .dims import TRACKER_PARTIES

LINES = [*TRACKER_PARTIES, "others"]


def parse_tracker(
    text: DataFrame, col: str = "value", parties: Sequence[str] = tuple(LINES)
) -> tuple[DataFrame, DataFrame]:
    """(poll points, model points) of tracker documents, one row per party.

    ``seq`` is the place of a point in its document, the tie order within a day.
    """
    shares = ", ".join(f"{p}: double" for p in parties)
    seats = ", ".join(f"{p}: int" for p in parties)
    schema = (
        f"struct<polls: array<struct<date: array<int>, company: string, {shares}>>,"
        f" models: array<struct<date: string, {seats}>>>"
    )
    doc = text.select(F.from_json(F.col(col), schema, {"mode": "FAILFAST"}).alias("doc"))
    polls = unpack(doc, [], F.posexplode_outer("doc.polls").alias("seq", "p"), "p").select("seq", "p.*").withColumn(
        "date", F.make_date(F.col("date")[2], F.col("date")[1], F.col("date")[0])
    )
    models = unpack(doc, [], F.explode_outer("doc.models").alias("m"), "m").select("m.*").withColumn(
        "date", F.to_date("date", "MM/dd/yyyy")
    )
    points = polls.unpivot(["seq", "date", "company"], list(parties), "party", "pct")
    return points, models.unpivot(["date"], list(parties), "party", "seats")


def read_tracker(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    return parse_tracker(spark.read.text(paths, wholetext=True))
