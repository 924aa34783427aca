"""Guess logs scored in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Heat bands, upper bound of the distance in years and band name.
BANDS = [(2, "1-2"), (10, "3-10"), (40, "11-40"), (200, "41-200"), (1000, "200-1000")]
BEYOND = "over 1000"


def signed_year(year: Column, era: Column) -> Column:
    """BC years are negative; there is no year 0."""
    return F.when(era == "BC", -year).otherwise(year)


def score_guesses(guesses: DataFrame, targets: DataFrame) -> DataFrame:
    """Distance in years, win by timeframe, and heat band of every guess."""
    joined = guesses.join(targets, "game_id")
    aim = signed_year(F.col("year"), F.col("era"))
    shot = signed_year(F.col("guess_year"), F.col("guess_era"))
    crossed = F.when(F.signum(aim) * F.signum(shot) < 0, 1).otherwise(0)
    distance = (F.abs(aim - shot) - crossed).cast("int")
    same_decade = F.floor(F.abs(aim) / 10) == F.floor(F.abs(shot) / 10)
    kind = F.col("timeframe_type")
    win = (
        ((kind == "year") & (F.col("distance") == 0))
        | ((kind == "decade") & (F.col("distance") < 10) & same_decade)
        | ((kind == "century") & (F.col("distance") < 100))
    )
    band = F.when(F.col("is_win"), "correct")
    for limit, name in BANDS:
        band = band.when(F.col("distance") <= limit, name)
    return (
        joined.withColumn("distance", distance)
        .withColumn("is_win", win)
        .withColumn("band", band.otherwise(BEYOND))
        .select(*guesses.columns, "distance", "is_win", "band")
    )


def first_attempts(guesses: DataFrame, max_attempts: int = 8) -> DataFrame:
    """The guesses that can count, numbered by ``attempt_no``.

    The rank limit is applied before the shuffle too, so a game with a very long log
    passes on ``max_attempts`` rows per task.
    """
    order = Window.partitionBy("game_id").orderBy("attempt")
    return guesses.withColumn("attempt_no", F.row_number().over(order)).where(F.col("attempt_no") <= max_attempts)


def game_outcomes(scored: DataFrame, max_attempts: int = 8) -> DataFrame:
    """Attempts used and result per game; guesses after a win or after the last attempt do not count.

    ``attempt`` orders the guesses of a game. Score only ``first_attempts`` where logs
    are long; they are numbered here otherwise.
    """
    counted = scored if "attempt_no" in scored.columns else first_attempts(scored, max_attempts)
    won_at = F.min(F.when(F.col("is_win"), F.col("attempt_no")))
    return counted.groupBy("game_id").agg(
        won_at.isNotNull().alias("won"),
        F.coalesce(won_at, F.max("attempt_no")).alias("attempts_used"),
        F.min("distance").alias("best_distance"),
        (won_at.isNull() & (F.max("attempt_no") == max_attempts)).alias("lost"),
    )
