"""Tab-separated poll files and the partitioned poll table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import unpack
from ..functions.numeric import number_or_zero
from .dims import MODEL_PARTIES
from .tables import replace_partitions, upsert_rows

HEADER = ["code", "company", "day", "month", "year", "region", "total"]
# Column order of the poll files.
FILE_PARTIES = [
    "conservative", "labour", "libdems", "ukip", "green", "snp", "plaidcymru", "other",
    "sdlp", "sinnfein", "alliance", "dup", "uu",
]


def unpivot_polls(wide: DataFrame, parties: Sequence[str] = tuple(MODEL_PARTIES)) -> DataFrame:
    """One row per poll area and party from one column per party."""
    keys = ["code", "company", "fieldwork_date", "area", "total"]
    long = wide.unpivot(keys, list(parties), "party", "n")
    return long.select("code", "company", "fieldwork_date", "area", "party", "n", "total")


def _date() -> Column:
    return F.concat(F.trim("year"), F.lit("-"), F.trim("month"), F.lit("-"), F.trim("day")).try_cast("date")


def parse_polls(
    raw: DataFrame, row_order: Sequence[str], parties: Sequence[str] = tuple(MODEL_PARTIES), blank_as_missing: bool = False
) -> DataFrame:
    """Poll rows from a text-typed table with the file's columns.

    The first row of a code in ``row_order`` gives its company and date; if an area is
    listed twice, the later row counts. Blank cells are 0, or NULL with ``blank_as_missing``;
    a date that is none is NULL.
    """

    def votes(name: str):
        cell = F.trim(F.col(name))
        return cell.try_cast("bigint") if blank_as_missing else number_or_zero(F.col(name))

    typed = raw.select(
        number_or_zero(F.col("code")).alias("code"),
        F.struct(*row_order).alias("row_no"),
        F.struct(
            F.trim("company").alias("company"),
            _date().alias("date"),
        ).alias("head"),
        F.col("region").alias("area"),
        F.struct(number_or_zero(F.col("total")).alias("total"), *[votes(p).alias(p) for p in parties]).alias("cells"),
    )
    areas = typed.groupBy("code", "area").agg(
        F.max_by("cells", "row_no").alias("cells"), F.min(F.struct("row_no", "head")).alias("first")
    )
    heads = areas.groupBy("code").agg(F.min("first").alias("first"))
    wide = areas.drop("first").join(heads, "code").select(
        "code", F.col("first.head.company").alias("company"), F.col("first.head.date").alias("fieldwork_date"),
        "area", "cells.*",
    )
    return unpivot_polls(wide, parties)


def poll_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows of poll files as text, with file, start of the block read, and row number."""
    schema = ", ".join(f"{c} string" for c in [*HEADER, *FILE_PARTIES])
    return spark.read.csv(path, sep="\t", header=True, schema=schema).select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )


def read_polls(
    spark: SparkSession, path: str | list[str], parties: Sequence[str] = tuple(MODEL_PARTIES), blank_as_missing: bool = False
) -> DataFrame:
    return parse_polls(poll_rows(spark, path), ["_file", "_start", "_row"], parties, blank_as_missing)


def poll_rejects(raw: DataFrame, where: Sequence[str], parties: Sequence[str] = tuple(MODEL_PARTIES)) -> DataFrame:
    """(``where``, cell, value, reason): cells that hold something which is not a count, and dates that are none.

    ``parse_polls`` reads such counts as 0 and such dates as NULL; here they come beside its rows. ``where``: the
    columns that tell the place of a row, such as file and line.
    """
    date = F.concat_ws("-", *(F.coalesce(F.trim(c), F.lit("")) for c in ("year", "month", "day")))
    number = lambda name: F.when(
        (F.trim(name) != "") & F.trim(name).try_cast("bigint").isNull(),
        F.struct(F.lit(name).alias("cell"), F.col(name).alias("value"), F.lit("not a whole number").alias("reason")),
    )
    no_date = F.struct(F.lit("date").alias("cell"), date.alias("value"), F.lit("not a date").alias("reason"))
    cells = [*(number(c) for c in ("code", "total", *parties)), F.when(_date().isNull(), no_date)]
    return unpack(raw, list(where), F.inline_outer(F.filter(F.array(*cells), lambda c: c.isNotNull())), "cell")


def save_polls(polls: DataFrame, path: str) -> None:
    """Poll table in Parquet, one folder per fieldwork year; years that ``polls`` has no rows for stay as they are."""
    replace_partitions(polls.withColumn("year", F.year("fieldwork_date")), path, ["year"])


def upsert_polls(polls: DataFrame, path: str) -> None:
    """Adds polls to a saved table, in place of those with the same code in the same year."""
    upsert_rows(polls.withColumn("year", F.year("fieldwork_date")), path, ["year"], ["code"])


def load_polls(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """The saved poll table; ``years`` prunes folders."""
    polls = spark.read.parquet(path)
    return (polls if years is None else polls.where(F.col("year").isin(list(years)))).drop("year")
