"""Sinks for batches and micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.upsert import close_and_insert


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName()[:1] == "v" and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest finished version of a table, or the one asked for; None if there is none."""
    have = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{have[-1] if version is None else version}") if have else None


def write_version(df: DataFrame, path: str) -> int:
    """A table as a new version; readers see it once it is complete, so a lost writer leaves the old one."""
    v = (_versions(df.sparkSession, path) or [0])[-1] + 1
    df.write.mode("overwrite").parquet(f"{path}/v{v}")
    return v


def upsert_history(updates: DataFrame, path: str, key: str) -> int:
    """Bitemporal upsert of (key, ..., valid_at, invalid_at) into a versioned table."""
    spark = updates.sparkSession
    old = read_version(spark, path)
    new = updates.withColumn("invalid_at", F.lit(None).cast("timestamp"))
    return write_version(new if old is None else close_and_insert(old, updates, key), path)


def capped(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_rn") <= n).drop("_rn")


def unexpired(df: DataFrame, as_of: str) -> DataFrame:
    return df.where(F.col("expires_at") > F.lit(as_of).cast("timestamp"))


def retained(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")).distinct()
