"""Election, poll, card and fact views over a star schema of Parquet tables.

They give every operator input that grows with the tables: suppliers are
seats, nations are regions, order priorities are parties, event users are
pollsters and players, document lines are facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import unpack
from .inline import inline_table

PARTIES = ["p1", "p2", "p3", "p4", "p5"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_suppkey").alias("seat"),
        F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("party"),
        "o_orderdate",
        "o_orderstatus",
        "l_quantity",
    )


def _with_ord(df: DataFrame) -> DataFrame:
    return df.withColumn("party_ord", F.substring("party", 2, 1).cast("int"))


def result(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """(election_id, seat, party, votes, party_ord): two elections, split by order date.

    ``only`` reads one of them, with the date range pushed to the scan.
    """
    rows = _votes(spark, sf_dir)
    # the literal takes the column's own timestamp type, so the comparison can reach the scan
    split = F.lit("1998-01-01").cast(rows.schema["o_orderdate"].dataType)
    if only is not None:
        rows = rows.where(F.col("o_orderdate") < split if only == "prev" else F.col("o_orderdate") >= split)
    votes = (
        rows
        .groupBy(F.when(F.col("o_orderdate") < split, "prev").otherwise("cur").alias("election_id"), "seat", "party")
        .agg(F.sum("l_quantity").cast("bigint").alias("votes"))
    )
    return _with_ord(votes)


def yearly_result(spark: SparkSession, sf_dir: str, closed_only: bool = False) -> DataFrame:
    """(date, seat, party, votes, party_ord): one election per order year, of all or of closed orders."""
    rows = _votes(spark, sf_dir)
    votes = (
        (rows.where(F.col("o_orderstatus") == "F") if closed_only else rows)
        .groupBy(F.trunc("o_orderdate", "year").alias("date"), "seat", "party")
        .agg(F.sum("l_quantity").cast("bigint").alias("votes"))
    )
    return _with_ord(votes)


def views(spark: SparkSession) -> DataFrame:
    """Two views: the latest election against the one before it, and against itself."""
    columns = {"view_id": "string", "current_id": "string", "previous_id": "string"}
    return inline_table(spark, columns, [("latest", "cur", "prev"), ("again", "cur", "cur")])


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))


def seat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seat, name, region, region_group, electorate, by_election)."""
    electorate = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("seat"))
        .agg(F.sum("l_quantity").cast("bigint").alias("electorate"))
    )
    suppliers = table(spark, sf_dir, "supplier").join(
        _places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")
    )
    # a left join: where the electorate is not asked for, the optimizer drops it and its scan
    return suppliers.join(electorate, F.col("s_suppkey") == F.col("seat"), "left").select(
        F.col("s_suppkey").alias("seat"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("region"),
        F.col("r_name").alias("region_group"),
        "electorate",
        F.when(F.col("s_suppkey") % 7 == 0, "May 6th 2021").alias("by_election"),
    )


def region_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select(F.col("r_name").alias("region_group"), F.col("n_name").alias("region"))


def poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, company, fieldwork_date, area, party, n, total), one row per party in every poll area."""
    party = (
        F.when(F.col("event_type") == "click", "p1")
        .when(F.col("event_type") == "error", "p2")
        .when(F.col("event_type") == "purchase", "p3")
        .when(F.col("event_type") == "signup", "p4")
        .otherwise("p5")
    )
    regions = table(spark, sf_dir, "region")
    keys = ["code", "company", "fieldwork_date", "area"]
    # one pass: the five party counts side by side, then unpivoted, so no cell is missing
    wide = (
        table(spark, sf_dir, "events")
        .select("user_id", F.floor("value").alias("v"), F.to_date("ts").alias("fieldwork_date"), party.alias("party"),
                F.dayofmonth("ts").alias("dom"))
        .join(regions, F.col("r_regionkey") == F.col("user_id") % 5)
        .groupBy(
            (F.col("dom") * 8 + F.col("user_id") % 8).alias("code"),
            F.concat(F.lit("c"), (F.col("user_id") % 8).cast("string")).alias("company"),
            "fieldwork_date",
            F.col("r_name").alias("area"),
        )
        .agg(
            *[F.coalesce(F.sum(F.when(F.col("party") == p, F.col("v"))), F.lit(0)).cast("bigint").alias(p)
              for p in PARTIES],
            F.sum("v").cast("bigint").alias("total"),
        )
    )
    return wide.unpivot([*keys, "total"], PARTIES, "party", "n").select(*keys, "party", "n", "total")


def pollster_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company, area, region): every area a company polled covers the nations of that area."""
    areas = (
        table(spark, sf_dir, "events")
        .select(F.concat(F.lit("c"), (F.col("user_id") % 8).cast("string")).alias("company"),
                (F.col("user_id") % 5).alias("k"))
        .distinct()
    )
    return areas.join(_places(spark, sf_dir), F.col("k") == F.col("r_regionkey")).select(
        "company", F.col("r_name").alias("area"), F.col("n_name").alias("region")
    )


def pollster(spark: SparkSession) -> DataFrame:
    """Weights for the eight companies of the poll view."""
    rows = [(f"c{i}", 1.0 + i / 4, "count", 50.0 if i == 7 else None) for i in range(8)]
    columns = {"company": "string", "base_weight": "double", "scale_kind": "string", "fixed_weight": "double"}
    return inline_table(spark, columns, rows)


def referendum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seat, leave, remain) in percent of the seat's quantity."""
    leave = F.try_divide(
        F.lit(100.0) * F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(F.lit(0.0))),
        F.sum("l_quantity"),
    )
    shares = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("seat")).agg(leave.alias("leave"))
    return shares.withColumn("remain", F.lit(100.0) - F.col("leave"))


def card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("card_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("card_class"),
        F.col("p_type").alias("type"),
        F.concat(F.lit("R"), (F.col("p_partkey") % 5).cast("string")).alias("rarity"),
        F.concat(F.lit("T"), (F.col("p_partkey") % 3).cast("string")).alias("race"),
        F.concat(F.lit("S"), (F.col("p_partkey") % 13).cast("string")).alias("card_set"),
        (F.col("p_size") % 12).alias("cost"),
        F.split("p_name", " ").alias("mechanics"),
    )


def guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_id, attempt, guess_year, guess_era); a player's own events give the attempt order."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("game_id"),
        F.col("event_id").alias("attempt"),
        (1 + F.floor(F.col("value") * 10) % 2000).cast("int").alias("guess_year"),
        F.when(F.col("event_id") % 4 == 0, "BC").otherwise("AD").alias("guess_era"),
    )


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("game_id")).distinct()
    return users.select(
        "game_id",
        (1 + (F.col("game_id") * 37) % 2000).cast("int").alias("year"),
        F.when(F.col("game_id") % 3 == 0, "BC").otherwise("AD").alias("era"),
        F.when(F.col("game_id") % 3 == 0, "century").when(F.col("game_id") % 3 == 1, "year").otherwise("decade")
        .alias("timeframe_type"),
    )


def link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(link_id, url): saved views made from the regions and parties that hold votes."""
    votes = result(spark, sf_dir).join(seat(spark, sf_dir).select("seat", "region"), "seat")
    # region and party, party alone, region alone: all three kinds of links from one pass
    held = votes.groupingSets([["region", "party"], ["party"], ["region"]], "region", "party").agg(
        F.grouping("region").alias("no_region"), F.grouping("party").alias("no_party")
    )
    base = F.lit("http://maps.example/?map=latest")
    region_no = (F.length("region") * 2 + F.substring("party", 2, 1).cast("int")).cast("string")
    gains = F.when(F.col("party") == "p1", F.lit("&gains=yes")).otherwise(F.lit(""))
    no_region, no_party = F.col("no_region") == 1, F.col("no_party") == 1
    return held.select(
        F.when(no_region, F.concat(F.lit("party-"), "party"))
        .when(no_party, F.concat(F.lit("duel-"), "region"))
        .otherwise(F.concat(F.lit("seats-"), "region", F.lit("-"), "party")).alias("link_id"),
        F.when(no_region, F.concat(base, F.lit("&incumbent="), F.upper("party"), F.lit("&byelection=true")))
        .when(no_party, F.concat(base, F.lit("&incumbent=p1&challenger=p2&majhigh=30&region="), "region"))
        .otherwise(F.concat(base, F.lit("&region="), "region", F.lit("&incumbent="), "party",
                            F.lit("&majlow=0&majhigh="), region_no, gains)).alias("url"),
    )


def boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    joined = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.where(~F.col("s_name").endswith("3")).select(
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("info_id"), F.col("n_name").alias("region")
    )


def fact(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """(fact_id, year, era, event): one fact per line of every document; ``more`` columns of the documents come along."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", *more)
    own = [c for c in documents.columns if c not in ("doc_id", "text")]
    lines = unpack(documents, ["doc_id", *own], F.posexplode_outer(F.split("text", "\n")).alias("pos", "event"), "event")
    return lines.select(
        *own,
        F.concat_ws(":", "doc_id", "pos").alias("fact_id"),
        (1 + F.col("doc_id") % 2000).cast("int").alias("year"),
        F.when(F.col("doc_id") % 5 == 0, "BC").otherwise("AD").alias("era"),
        "event",
    )
