"""Stateful rules over one entity's ordered rows: crossings, cooldowns, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import FAN, Cooldown, Crossing, fold
from .signals import CHUNK, carried, chunked, own


def crossings(scores: DataFrame, cooldown_s: float, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Fired crossings (entity, n, rank): into a band of rank 3 or more, above the last band fired,
    after the cooldown. Falling below rank 2 resets the last band.
    """
    d = fold(scores, "entity", "observed_at", "flush", "rank", Crossing(cooldown_s), size, fan)
    return d.where("fired").select("entity", "n", F.col("value").alias("rank"))


def cooldown(rows: DataFrame, seconds: float, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``kept``: the first of an entity, and each that comes ``seconds`` or more after the last kept one."""
    d = fold(rows.withColumn("_one", F.lit(1)), "entity", "ts", "event_id", "_one", Cooldown(seconds), size, fan)
    return d.select("entity", "event_id", F.col("fired").alias("kept"))


def expired(scores: DataFrame, ttl_h: int, size: int = CHUNK) -> DataFrame:
    """Rises into ``elevated`` that no action or critical state of the entity follows within ``ttl_h`` hours."""
    d, w = chunked(scores.select("entity", "observed_at", "flush", "band"), "entity", "observed_at", "flush", 1, size)
    s = own(d.withColumn("was", F.lag("band", 1, "calm").over(w)))
    rise = (F.col("band") == "elevated") & F.col("was").isin("calm", "watch")
    hit = F.col("band").isin("action", "critical")
    # of rows of one time, hits come first: they don't follow
    s = s.where(rise | hit).withColumn("tie", F.struct((~hit).alias("later"), "flush"))
    s = carried(s, "entity", "observed_at", "tie", F.when(hit, F.struct("observed_at")), size)
    late = F.col("after").isNull() | (F.col("after.observed_at") > F.col("observed_at") + F.expr(f"interval {ttl_h} hours"))
    return s.where(rise & late).select("entity", F.col("observed_at").alias("opened_at"))
