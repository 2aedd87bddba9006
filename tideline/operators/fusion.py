"""Signals to features, fused risk scores and their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FLUSH_SIZE, HALF_LIFE_H
from ..functions.scores import half_life, risk_band

FEATURES = [
    "ais_gap_count_24h", "ais_dark_vessel_count", "ais_anomaly_score_max", "ais_gap_duration_max_h", "ais_monitored_cell_pct", "ais_velocity_std",
    "gdelt_tone_24h_mean", "gdelt_tone_delta", "news_severity_max", "news_event_count_24h",
    "price_brent_pct_change_24h", "price_war_risk_premium", "price_bocd_flag", "price_regime",
    "sanctions_new_additions_24h", "sanctions_vessel_count", "sanctions_major_entity",
]


def numbered(df: DataFrame, key: str, ts: str, tie: str, bucket: str = "day") -> DataFrame:
    """``rn``: place of each row of a key by (ts, tie), from 1.

    A key's rows are never sorted in one task: they are numbered within a time bucket, and the
    buckets' counts, which are few, give each bucket its offset.
    """
    df = df.withColumn("_bucket", F.date_trunc(bucket, F.col(ts)))
    counts = df.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(ts, tie))
    return df.join(offsets, [key, "_bucket"]).withColumn("rn", inside + F.col("_offset")).drop("_bucket", "_offset")


def flushes(sig: DataFrame, size: int = FLUSH_SIZE) -> DataFrame:
    """Signals with the number of the count-triggered batch of their entity."""
    return numbered(sig, "entity", "ts", "event_id").withColumn("flush", F.floor((F.col("rn") - 1) / size))


def features(sig: DataFrame, *keys: str) -> DataFrame:
    """The 17 features of each group, in one aggregation that combines before it shuffles."""
    ais, talk, price, sanc = F.col("source") == "ais", F.col("source").isin("gdelt", "news"), F.col("source") == "price", F.col("source") == "sanctions"
    num = lambda c: F.count_if(c).cast("double")
    top = lambda c, on: F.coalesce(F.max(F.when(on, F.greatest(c, F.lit(0.0)))), F.lit(0.0))
    mean = lambda c, on: F.coalesce(F.avg(F.when(on, c)), F.lit(0.0))
    last = lambda c, on: F.coalesce(F.max_by(c, F.when(on, F.struct("ts", "event_id"))), F.lit(0.0))
    return sig.groupBy(*keys).agg(
        num(ais & (F.col("gap_hours") > 4)).alias("ais_gap_count_24h"),
        num(ais & F.col("dark")).alias("ais_dark_vessel_count"),
        top(F.col("anomaly"), ais).alias("ais_anomaly_score_max"),
        top(F.col("gap_hours"), ais).alias("ais_gap_duration_max_h"),
        (F.count_if(ais & F.col("monitored")) / F.greatest(F.count_if(ais), F.lit(1))).alias("ais_monitored_cell_pct"),
        mean(F.col("vstd"), ais).alias("ais_velocity_std"),
        mean(F.col("tone"), talk & (F.col("tone") != 0)).alias("gdelt_tone_24h_mean"),
        mean(F.col("tone_delta"), talk).alias("gdelt_tone_delta"),
        top(F.col("severity"), talk).alias("news_severity_max"),
        num(talk & (F.col("severity") > 0.7)).alias("news_event_count_24h"),
        last(F.col("pct"), price).alias("price_brent_pct_change_24h"),
        top(F.col("premium"), price).alias("price_war_risk_premium"),
        F.coalesce(F.max(F.when(price & F.col("changepoint"), 1.0)), F.lit(0.0)).alias("price_bocd_flag"),
        last(F.col("stressed").cast("double"), price).alias("price_regime"),
        num(sanc & F.col("added")).alias("sanctions_new_additions_24h"),
        num(sanc & F.col("is_vessel")).alias("sanctions_vessel_count"),
        F.coalesce(F.max(F.when(sanc & F.col("added") & F.col("is_state"), 1.0)), F.lit(0.0)).alias("sanctions_major_entity"),
        F.max("ts").alias("observed_at"),
    )


def _cap(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def _ratio(name: str, by: float) -> Column:
    return _cap(F.col(name) / by)


def _below(name: str, by: float) -> Column:
    return F.greatest(F.lit(0.0), -F.col(name) / by)


def fuse_consumer(f: DataFrame) -> DataFrame:
    """Weighted fusion with unweighted factors, score and band."""
    c = F.col
    ais = _cap(0.35 * _ratio("ais_dark_vessel_count", 3) + 0.25 * _ratio("ais_gap_count_24h", 5) + 0.20 * c("ais_anomaly_score_max") + 0.10 * _ratio("ais_gap_duration_max_h", 24) + 0.05 * c("ais_monitored_cell_pct") + 0.05 * _ratio("ais_velocity_std", 5))
    news = _cap(0.40 * _below("gdelt_tone_24h_mean", 10) + 0.20 * _below("gdelt_tone_delta", 5) + 0.25 * c("news_severity_max") + 0.15 * _ratio("news_event_count_24h", 5))
    price = _cap(0.30 * _cap(F.abs("price_brent_pct_change_24h") / 10) + 0.35 * c("price_bocd_flag") + 0.20 * c("price_regime") + 0.15 * _cap(c("price_war_risk_premium")))
    sanctions = _cap(0.40 * _ratio("sanctions_new_additions_24h", 2) + 0.35 * c("sanctions_major_entity") + 0.25 * _ratio("sanctions_vessel_count", 3))
    f = f.withColumns({"factor_ais": ais, "factor_gdelt": news, "factor_price": price, "factor_sanctions": sanctions})
    f = f.withColumn("score", F.round(_cap(0.30 * c("factor_ais") + 0.30 * c("factor_gdelt") + 0.25 * c("factor_price") + 0.15 * c("factor_sanctions")), 9))
    return f.withColumn("band", risk_band(c("score")))


def fuse_sensory(f: DataFrame) -> DataFrame:
    """The sensory model's fusion; its factors carry their weights."""
    c = F.col
    ais = _cap(0.4 * _ratio("ais_dark_vessel_count", 5) + 0.3 * c("ais_anomaly_score_max") + 0.3 * _ratio("ais_gap_count_24h", 10))
    news = _cap(0.5 * _below("gdelt_tone_24h_mean", 10) + 0.3 * c("news_severity_max") + 0.2 * _ratio("news_event_count_24h", 5))
    price = _cap(0.4 * _cap(F.abs("price_brent_pct_change_24h") / 10) + 0.4 * c("price_bocd_flag") + 0.2 * c("price_regime"))
    sanctions = _cap(0.5 * c("sanctions_major_entity") + 0.3 * _ratio("sanctions_new_additions_24h", 3) + 0.2 * _ratio("sanctions_vessel_count", 10))
    f = f.withColumns({"factor_ais": 0.35 * ais, "factor_gdelt": 0.25 * news, "factor_price": 0.25 * price, "factor_sanctions": 0.15 * sanctions})
    return f.withColumn("score", F.round(_cap(c("factor_ais") + c("factor_gdelt") + c("factor_price") + c("factor_sanctions")), 9))


def rationale(f: DataFrame) -> DataFrame:
    """Factors above 0.15, the largest first, as text."""
    parts = F.array(*[F.struct((-F.col(n)).alias("v"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, (n, t) in enumerate((("factor_ais", "AIS"), ("factor_gdelt", "GDELT"), ("factor_price", "price"), ("factor_sanctions", "sanctions")))])
    named = F.transform(F.filter(F.sort_array(parts), lambda x: -x["v"] > 0.15), lambda x: x["t"])
    return f.withColumn("drivers", F.concat_ws(", ", named))


def decayed(scores: DataFrame, half: float = HALF_LIFE_H) -> DataFrame:
    """Each score, or an earlier one of the entity halved every ``half`` hours if that is higher.

    Closed form: with scores on a log scale a halving is a straight line, so a running maximum
    does for the recurrence.
    """
    t = F.col("observed_at").cast("double") / 3600 / half
    origin = F.lit(1704067200.0 / 3600 / half)
    level = F.when(F.col("score") > 0, F.log2("score") + t - origin)
    run = F.max(level).over(Window.partitionBy("entity").orderBy("observed_at", "flush").rowsBetween(Window.unboundedPreceding, 0))
    return scores.withColumn("decayed", F.coalesce(F.pow(F.lit(2.0), run - (t - origin)), F.lit(0.0)))


def scd2(scores: DataFrame) -> DataFrame:
    """Bitemporal history: a row is valid until the entity's next one; the open row has no end."""
    w = Window.partitionBy("entity").orderBy("observed_at", "flush")
    return scores.withColumn("valid_at", F.col("observed_at")).withColumn("invalid_at", F.lead("observed_at").over(w))


def current(scores: DataFrame) -> DataFrame:
    """The last state of each entity."""
    cols = [c for c in scores.columns if c != "entity"]
    return scores.groupBy("entity").agg(F.max_by(F.struct(*cols), F.struct("observed_at", "flush")).alias("s")).select("entity", "s.*")


def prior_decay(scores: DataFrame, half: float = HALF_LIFE_H) -> DataFrame:
    """Each state with its predecessor's score and what is left of it by now."""
    w = Window.partitionBy("entity").orderBy("observed_at", "flush")
    gap = (F.col("observed_at").cast("double") - F.lag("observed_at").over(w).cast("double")) / 3600
    return scores.withColumn("prior", F.lag("score").over(w)).withColumn("prior_left", F.lag("score").over(w) * half_life(gap, half))
