"""Equi-joins on few, hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Hot keys at most, whatever the number of rows; a row for each is broadcast.
MOST_HOT = 100_000


def spread_join(
    many: DataFrame, few: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner", rows: int = 100_000
) -> DataFrame:
    """``many`` joined to ``few`` on ``keys``, with every hot key spread over a task for each ``rows`` rows of ``many``.

    ``many`` is computed once, into the shared folder, and its keys are counted there. A key with more than ``rows`` rows is
    hot; there are at most ``MOST_HOT`` of them, as ``rows`` grows with the number of all rows beyond that, so their counts can
    be broadcast. Rows of a hot key are salted by the hash of ``by`` in ``many`` and repeated for its salts in ``few``.
    Without hot keys this is a plain join.
    """
    many = stored(many, "spread")
    least = max(rows, many.count() // MOST_HOT)
    parts = F.ceil(F.count(F.lit(1)) / F.lit(least)).cast("int").alias("_n_salts")
    hot = stored(many.groupBy(*keys).agg(parts).where("_n_salts > 1"), "hot")
    if hot.isEmpty():
        return many.join(few, list(keys), how)
    hot = F.broadcast(hot)  # at most MOST_HOT rows
    salt = F.pmod(F.xxhash64(*by), F.coalesce("_n_salts", F.lit(1))).cast("int")
    salted = many.join(hot, list(keys), "left").withColumn("_salt", salt).drop("_n_salts")
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("_n_salts", F.lit(1)) - 1))
    spread = few.join(hot, list(keys), "left").withColumn("_salt", salts).drop("_n_salts")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
