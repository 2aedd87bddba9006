"""Projections of series and the probability of crossing a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HORIZONS_H, REVERSION, Z90


def project(df: DataFrame, series: str, cap: float) -> DataFrame:
    """Median and 10-90 band at each horizon: the last level, the recent drift dying out, the steps' spread."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(cap), x))
    diffs = F.expr(f"transform(sequence(1, size({series}) - 1), i -> {series}[i] - {series}[i - 1])")
    d = df.where(F.size(series) > 1).withColumn("_d", diffs).withColumn("_level", F.element_at(series, -1))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    d = d.withColumn("_drift", mean(F.expr("slice(_d, greatest(1, size(_d) - 2), 3)"))).withColumn("_m", mean(F.col("_d")))
    d = d.withColumn("_vol", F.greatest(F.sqrt(mean(F.transform("_d", lambda x: (x - F.col("_m")) * (x - F.col("_m"))))), F.lit(0.05 * cap)))
    d = d.withColumn("hours", F.explode(F.array(*[F.lit(h) for h in HORIZONS_H])))
    steps = F.col("hours") / 6.0
    d = d.withColumn("median", clamp(F.col("_level") + F.col("_drift") * (1 - F.pow(F.lit(REVERSION), steps)) / (1 - REVERSION)))
    half = Z90 * F.col("_vol") * F.sqrt(steps)
    return d.withColumn("p10", clamp(F.col("median") - half)).withColumn("p90", clamp(F.col("median") + half)).drop("_d", "_level", "_drift", "_m", "_vol")


def crossing(bands: DataFrame, base: DataFrame, paths: int = 500, threshold: float = 0.2634, seed: int = 11) -> DataFrame:
    """(entity, probability, median and 10-90 hours): paths draw one number a step for both series."""
    p = bands.join(base, "entity").crossJoin(F.broadcast(bands.sparkSession.range(paths).withColumnRenamed("id", "path")))
    # a hash makes the draws the same however the rows are dealt out
    u = F.conv(F.left(F.md5(F.concat_ws(":", "entity", "hours", "path", F.lit(seed)).cast("binary")), F.lit(8)), 16, 10).cast("double") / 2.0**32
    at = lambda lo, hi: F.col(lo) + u * (F.col(hi) - F.col(lo))
    risk = F.least(F.lit(1.0), 0.35 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), at("a10", "a90") / 5)) + 0.25 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), at("b10", "b90"))) + F.col("base"))
    first = p.where(risk > threshold).groupBy("entity", "path").agg(F.min("hours").alias("h"))
    w = first.groupBy("entity").agg((F.count("*") / paths).alias("probability"), F.sort_array(F.collect_list("h")).alias("hs"))
    all_ = base.select("entity").distinct().join(w, "entity", "left")
    pick = lambda q: F.coalesce(F.expr(f"hs[cast(floor({q}D * size(hs)) as int)]").cast("double"), F.lit(float("inf")))
    return all_.select("entity", F.coalesce("probability", F.lit(0.0)).alias("probability"), pick(0.5).alias("median_h"), pick(0.1).alias("p10_h"), pick(0.9).alias("p90_h"))


def rising(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return df.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order)))


#: How a hypothetical scales the bands at a horizon: (vessel series, premium series).
SHOCKS = {
    "resolves": (lambda h: F.exp(-h / 72.0), lambda h: F.exp(-h / 72.0)),
    "cheap_oil": (lambda h: F.lit(1.0), lambda h: F.lit(0.1)),
    "other_supply": (lambda h: F.lit(0.65), lambda h: F.lit(0.65)),
}


def counterfactuals(bands: DataFrame, base: DataFrame, paths: int = 500, threshold: float = 0.2634, seed: int = 11) -> DataFrame:
    """(entity, type, probability, delta): crossing probability under each shock and its change; the baseline stays as it is.

    All futures draw the same numbers, so a shock that lowers the bands never raises the probability.
    """
    before = crossing(bands, base, paths, threshold, seed).select("entity", F.col("probability").alias("_p"))
    out = None
    for name, (vessels, premium) in SHOCKS.items():
        h = F.col("hours").cast("double")
        shocked = bands.withColumns({c: F.col(c) * vessels(h) for c in ("a10", "a90")} | {c: F.col(c) * premium(h) for c in ("b10", "b90")})
        part = crossing(shocked, base, paths, threshold, seed).withColumn("type", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.join(before, "entity").select("entity", "type", "probability", (F.col("probability") - F.col("_p")).alias("delta"))


def severity_24h(median_vessels: Column, median_premium: Column) -> Column:
    """The stronger of the two signals a day ahead, within 0..1."""
    return F.round(F.greatest(F.least(F.lit(1.0), median_vessels / 5), F.least(F.lit(1.0), median_premium)), 3)
