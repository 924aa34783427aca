"""Literal tables with known size, so the optimizer itself decides to broadcast them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _literal(value: object, kind: str) -> str:
    if value is None:
        return f"cast(null as {kind})"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'" if kind == "string" else f"cast('{escaped}' as {kind})"
    return f"cast({str(value).lower()} as {kind})"


def inline_table(spark: SparkSession, columns: dict[str, str], rows: Iterable[Sequence]) -> DataFrame:
    """A DataFrame over an inline ``VALUES`` list (``columns``: name -> SQL type)."""
    kinds = list(columns.values())
    body = ", ".join(
        "(" + ", ".join(_literal(v, k) for v, k in zip(row, kinds, strict=True)) + ")" for row in rows
    )
    names = ", ".join(columns)
    if not body:
        fields = ", ".join(f"cast(null as {k}) as {n}" for n, k in columns.items())
        return spark.sql(f"select {fields} where false")
    return spark.sql(f"select * from values {body} as t({names})")
