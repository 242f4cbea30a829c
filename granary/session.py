"""The one place where sessions are built."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "granary", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution; sizes are left to the cluster unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    if partitions:
        own["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=own | conf).getOrCreate()
