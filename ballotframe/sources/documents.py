"""Seat-keyed JSON documents: results, predictions, by-election overrides, referendum."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import unpack
from .dims import PARTIES

SEAT_DOCUMENT = (
    "map<string, struct<"
    "seatInfo: struct<name: string, region: string, current: string, electorate: bigint, majority: bigint,"
    " byElection: string>,"
    "partyInfo: map<string, struct<name: string, total: double, standing: int>>>>"
)
REFERENDUM_DOCUMENT = (
    "map<string, struct<region: string, winner2015: string, current: string, leave: double, remain: double>>"
)
_STRICT = {"mode": "FAILFAST"}
LABELS = dict(PARTIES)


def _read_text(spark: SparkSession, paths: str | list[str], lines: bool) -> DataFrame:
    return spark.read.text(paths, wholetext=not lines)


def parse_documents(text: DataFrame, election_id: Column | str, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Splits seat documents into ``seat`` and ``result`` rows, parties in document order."""
    key = F.lit(election_id) if isinstance(election_id, str) else election_id
    parsed = unpack(
        text, [key.alias("election_id")],
        F.explode_outer(F.from_json(F.col(col), SEAT_DOCUMENT, _STRICT)).alias("seat", "doc"), "seat",
    )
    seats = parsed.select(
        "election_id", "seat",
        F.coalesce("doc.seatInfo.name", "seat").alias("name"),
        F.col("doc.seatInfo.region").alias("region"),
        F.col("doc.seatInfo.electorate").alias("electorate"),
        F.col("doc.seatInfo.current").alias("current_declared"),
        F.col("doc.seatInfo.majority").alias("majority_declared"),
        F.col("doc.seatInfo.byElection").alias("by_election"),
    )
    results = unpack(
        parsed, ["election_id", "seat"],
        F.posexplode_outer(F.map_entries("doc.partyInfo")).alias("party_ord", "entry"), "entry",
    ).select(
        "election_id", "seat",
        F.col("entry.key").alias("party"),
        F.col("entry.value.name").alias("candidate"),
        F.col("entry.value.total").cast("bigint").alias("votes"),
        F.col("entry.value.standing").alias("standing"),
        "party_ord",
    )
    return seats, results


def read_results(
    spark: SparkSession, paths: str | list[str], election_id: str, lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(seats, results) of one election, a prediction, or by-election overrides.

    ``lines=False``: whole files, each one object keyed by seat. ``lines=True``: one
    object per line, as ``write_results`` writes them, which can be split among tasks.
    """
    return parse_documents(_read_text(spark, paths, lines), election_id)


def with_by_election_date(seats: DataFrame) -> DataFrame:
    """Adds ``by_election_date`` parsed from English text such as ``May 6th 2021``."""
    plain = F.regexp_replace("by_election", r"(\d+)(st|nd|rd|th)", "$1")
    return seats.withColumn("by_election_date", F.try_to_timestamp(plain, F.lit("MMMM d yyyy")).cast("date"))


def to_seat_documents(
    packed: DataFrame, keys: list[str] | tuple[str, ...], current: str = "winner", labels: Mapping[str, str] = LABELS
) -> DataFrame:
    """One JSON object per packed seat: keys and ``value``.

    A party's name is its candidate, where ``parties`` has one, else its label. ``standing`` is written where it is
    set. Documents call the party ``other`` ``others``.
    """
    fields = packed.schema["parties"].dataType.elementType.names
    names = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)) if labels else None

    def name(p: Column) -> Column:
        label = F.coalesce(names[p["party"]], p["party"]) if names is not None else p["party"]
        return F.coalesce(p["candidate"], label) if "candidate" in fields else label

    def entry(p: Column) -> Column:
        key = F.when(p["party"] == "other", "others").otherwise(p["party"])
        value = [name(p).alias("name"), p["votes"].alias("total")]
        if "standing" in fields:
            value.append(p["standing"].alias("standing"))
        return F.struct(key.alias("key"), F.struct(*value).alias("value"))

    info = F.struct(
        F.col("seat").cast("string").alias("name"), "region", F.col(current).alias("current"),
        F.col("electorate").cast("bigint").alias("electorate"), F.col("majority").cast("bigint").alias("majority"),
    )
    parties = F.map_from_entries(F.transform("parties", entry))
    document = F.create_map(
        F.col("seat").cast("string"), F.struct(info.alias("seatInfo"), parties.alias("partyInfo"))
    )
    return packed.select(*keys, F.to_json(document).alias("value"))


def write_results(packed: DataFrame, path: str, keys: list[str] | tuple[str, ...], mode: str = "overwrite") -> None:
    """Writes one JSON line per seat, in one folder per scenario or election."""
    to_seat_documents(packed, keys).write.mode(mode).partitionBy(*keys).text(path)


def parse_referendum(text: DataFrame, col: str = "value") -> DataFrame:
    rows = unpack(
        text, [], F.explode_outer(F.from_json(F.col(col), REFERENDUM_DOCUMENT, _STRICT)).alias("seat", "doc"), "seat"
    )
    return rows.select("seat", "doc.*")


def read_referendum(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    return parse_referendum(_read_text(spark, paths, lines))
