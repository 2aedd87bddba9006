"""Feeds: one item a key, the newest of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup(items: DataFrame, key: Column, id_col: str) -> DataFrame:
    """The first item of each key and how many share it; minima combine before the shuffle."""
    return items.groupBy(key.alias("k")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))


def newest(items: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The ``n`` newest of each key, cut down within tasks first: no key's rows meet in one task whole."""
    rest = [c for c in items.columns if c not in (key, order)]
    salted = items.groupBy(key, F.pmod(F.xxhash64(order), F.lit(16)).alias("_s")).agg(F.slice(F.sort_array(F.collect_list(F.struct(order, *rest)), False), 1, n).alias("x"))
    return salted.select(key, F.inline("x")).groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct(order, *rest)), False), 1, n).alias("x")).select(key, F.inline("x"))
