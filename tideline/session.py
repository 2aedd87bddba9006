"""SparkSession with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tideline", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return b.config(map=settings | conf).getOrCreate()
