"""Session settings the operators are tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "ballotframe", **extra: str) -> SparkSession:
    """A session with adaptive execution on; on a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench: one JVM, one shuffle partition per thread."""
    cpus = cpus or os.cpu_count() or 8
    spark = get_session(
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory},
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
