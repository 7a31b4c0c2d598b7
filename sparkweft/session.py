"""Session factory: adaptive execution on, UTC, partitions sized by the caller."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **extra: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName("sparkweft")
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | extra
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
