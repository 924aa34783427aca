"""Intermediate tables in the folder that driver and executors share, and row numbers over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder below the warehouse in local mode, and an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    The lineage ends there: a lost executor costs a read, not the job so far. The files stay
    until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_ordinal(df: DataFrame, order: Sequence[Column], name: str = "ordinal", keys: Sequence[str] = ()) -> DataFrame:
    """Adds the row number from 1 in the order ``order``, of all rows or of those of equal ``keys``, without one task for all.

    Rows are cut into ranges of the order, sorted and stored; the rows of each range are counted, and their sums before
    each range, a row for each range and key in it, are added to the place in the range. Rows that are equal
    in ``order`` are numbered in any order, and spread over ranges however many they are.
    """
    spread = "_spread"
    by = [*(F.col(k).asc() for k in keys), *order, F.col(spread).asc()]
    rows = df.withColumn(spread, F.xxhash64(F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop(spread)
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33).alias("_range")
    firsts = rows.groupBy(part, *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = firsts.select("_range", *keys, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = [F.col("_range") == F.col("_of_range"), *(F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys)]
    starts = starts.select(F.col("_range").alias("_of_range"), *(F.col(k).alias(f"_of_{k}") for k in keys), "_first", "_before")
    on = same[0]
    for more in same[1:]:
        on = on & more
    numbered = rows.withColumn("_range", part).join(starts, on)
    return numbered.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))
