"""Structured Streaming forms of the signal operators.

Event time, with a watermark for late rows, stands in for arrival order. Window aggregations
share their expressions with the batch operators; rules that remember something of an entity
are stateful operators, so a restart from the checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import FIRE_COOLDOWN_S, FLUSH_SIZE, HALF_LIFE_H
from ..operators.fusion import features, fuse_consumer

EVENT = "event_id long, ts timestamp, entity int, source string, gap_hours double, anomaly double, dark boolean, monitored boolean, vstd double, tone double, tone_delta double, severity double, pct double, changepoint boolean, stressed boolean, premium double, added boolean, is_vessel boolean, is_state boolean"


def read_signals(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Signals landing as Parquet files."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).parquet(path)


def valid_envelopes(lines: DataFrame, schema: T.StructType, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(signals, broken lines) of JSON text."""
    full = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    parsed = lines.select(F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("x"), F.col(column).alias("line"))
    bad = F.col("x").isNull() | F.col("x._broken").isNotNull() | F.col("x.signal_id").isNull()
    return parsed.where(~bad).select("x.*").drop("_broken"), parsed.where(bad).select("line")


def windowed_scores(signals: DataFrame, window: str = "24 hours", slide: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Features and fused score of each entity in sliding event-time windows."""
    f = features(signals.withWatermark("ts", late).withColumn("w", F.window("ts", window, slide)), "entity", "w")
    return fuse_consumer(f).select("entity", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "score", "band")


def deduped(items: DataFrame, key: str, ts: str, within: str = "1 day") -> DataFrame:
    return items.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def clusters(pings: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row a cell and five minutes."""
    return pings.withWatermark("ts", late).groupBy("cell", F.window("ts", "5 minutes")).agg(F.count_if("dark").alias("dark"), F.max("gap_hours").alias("max_gap"), F.max("anomaly").alias("top"))


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")


def flushes(signals: DataFrame, size: int = FLUSH_SIZE) -> DataFrame:
    """Count-triggered batches: (entity, flush, event ids) each time an entity has ``size`` more signals."""

    def step(key, frames, state: GroupState):
        n, held = state.get if state.exists else (0, [])
        held = [*held, *_ordered(frames)["event_id"].tolist()]
        out = []
        while len(held) >= size:
            out.append((key[0], n, held[:size]))
            held, n = held[size:], n + 1
        state.update((n, held))
        yield pd.DataFrame(out, columns=["entity", "flush", "ids"])

    return signals.select("entity", "ts", "event_id").groupBy("entity").applyInPandasWithState(step, "entity int, flush long, ids array<long>", "n long, held array<long>", "append", GroupStateTimeout.NoTimeout)


def decayed(scores: DataFrame, half: float = HALF_LIFE_H) -> DataFrame:
    """Running score of each entity: the new one, or what is left of the old one if that is more."""

    def step(key, frames, state: GroupState):
        value, at = state.get if state.exists else (0.0, 0.0)
        out = []
        for r in _ordered(frames).itertuples():
            t = r.ts.timestamp()
            value = max(r.score, value * 0.5 ** (max(0.0, t - at) / 3600 / half) if at else 0.0)
            at = t
            out.append((key[0], r.event_id, value))
        state.update((value, at))
        yield pd.DataFrame(out, columns=["entity", "event_id", "decayed"])

    return scores.select("entity", "ts", "event_id", "score").groupBy("entity").applyInPandasWithState(step, "entity int, event_id long, decayed double", "value double, t double", "append", GroupStateTimeout.NoTimeout)


def crossings(scores: DataFrame, cooldown_s: float = FIRE_COOLDOWN_S) -> DataFrame:
    """Fired band crossings of (entity, ts, event_id, rank), as the batch rule has them."""

    def step(key, frames, state: GroupState):
        last, at = state.get if state.exists else (0, -1.0)
        out = []
        for r in _ordered(frames).itertuples():
            t = r.ts.timestamp()
            if r.rank >= 3 and r.rank > last and (at < 0 or t - at >= cooldown_s):
                last, at = int(r.rank), t
                out.append((key[0], r.event_id, last))
            elif r.rank < 2:
                last = 0
        state.update((last, at))
        yield pd.DataFrame(out, columns=["entity", "event_id", "rank"])

    return scores.select("entity", "ts", "event_id", "rank").groupBy("entity").applyInPandasWithState(step, "entity int, event_id long, rank int", "last int, t double", "append", GroupStateTimeout.NoTimeout)


def moments(ticks: DataFrame) -> DataFrame:
    """Changepoint state of each instrument: count, mean and squared deviations of its log returns."""
    import math

    def step(key, frames, state: GroupState):
        n, mean, m2, prev = state.get if state.exists else (0, 0.0, 0.0, None)
        out = []
        for r in _ordered(frames).itertuples():
            z = 0.0
            if prev is not None:
                x = math.log(r.price / prev) if prev > 0 and r.price > 0 else 0.0
                n += 1
                d = x - mean
                mean += d / n
                m2 += d * (x - mean)
                z = abs(x - mean) / math.sqrt(max(m2 / (n - 1), 1e-12)) if n >= 5 else 0.0
            prev = r.price
            out.append((key[0], r.event_id, z))
        state.update((n, mean, m2, prev))
        yield pd.DataFrame(out, columns=["instrument", "event_id", "z"])

    return ticks.select("instrument", "ts", "event_id", "price").groupBy("instrument").applyInPandasWithState(step, "instrument int, event_id long, z double", "n long, mean double, m2 double, prev double", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, in micro-batches handed to ``write(batch, id)``; then the query ends."""
    return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
