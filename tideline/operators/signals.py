"""Per-series operators on prices, vessel positions, tones and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..constants import CP_PROBABILITY, CP_Z, HAZARD, REGIME_VOL
from .fusion import numbered


#: Rows of a key that are ordered together; a key has as many chunks as it needs.
CHUNK = 16_384


def chunked(rows: DataFrame, key: str, ts: str, tie: str, before: int, size: int = CHUNK) -> tuple[DataFrame, WindowSpec]:
    """The rows in chunks of ``size`` of each key's order, and a window over a chunk in that order.

    The last ``before`` rows of a chunk stand once more at the head of the next (``_own`` is false
    there), so a frame of so many preceding rows is whole in every chunk and no task orders a key.
    """
    d = numbered(rows, key, ts, tie).withColumn("_at", F.col("rn") - 1).drop("rn")
    home = F.floor(F.col("_at") / size)
    d = d.withColumn("_home", home).withColumn("_chunk", F.explode(F.when(F.col("_at") % size >= size - before, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    return d.withColumn("_own", F.col("_home") == F.col("_chunk")).drop("_home"), Window.partitionBy(key, "_chunk").orderBy("_at")


def ahead(rows: DataFrame, key: str, ts: str, tie: str, size: int = CHUNK) -> tuple[DataFrame, WindowSpec]:
    """As ``chunked``, but the first row of a chunk stands once more at the tail of the chunk before, for frames of one following row."""
    d = numbered(rows, key, ts, tie).withColumn("_at", F.col("rn") - 1).drop("rn")
    home = F.floor(F.col("_at") / size)
    d = d.withColumn("_home", home).withColumn("_chunk", F.explode(F.when((F.col("_at") % size == 0) & (F.col("_at") > 0), F.array(F.col("_home") - 1, "_home")).otherwise(F.array("_home"))))
    return d.withColumn("_own", F.col("_home") == F.col("_chunk")).drop("_home"), Window.partitionBy(key, "_chunk").orderBy("_at")


def own(rows: DataFrame) -> DataFrame:
    return rows.where("_own").drop("_own", "_chunk", "_at")


def earlier(rows: DataFrame, key: str, **sums: Column) -> DataFrame:
    """(key, _chunk, sums over all earlier chunks of the key): one row a chunk, so the window over them is small."""
    w = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    g = rows.where("_own").groupBy(key, "_chunk").agg(*[c.alias(n) for n, c in sums.items()])
    return g.select(key, "_chunk", *[F.coalesce(F.sum(n).over(w), F.lit(0.0)).alias(n) for n in sums])


def returns(price: str, w: WindowSpec) -> Column:
    """Log return on the price before; 0 where one of the two is not positive, null without a price before."""
    prev = F.lag(price).over(w)
    return F.when(prev.isNotNull(), F.when((prev > 0) & (F.col(price) > 0), F.ln(F.col(price) / F.nullif(prev, F.lit(0.0)))).otherwise(0.0))


def changepoints(ticks: DataFrame, key: str = "instrument", ts: str = "ts", tie: str = "event_id", price: str = "price", size: int = CHUNK) -> DataFrame:
    """Log returns with running moments, change probability, flags and the change since the last flagged price.

    Moments up to a row are those of the earlier chunks merged with those of the row's own chunk;
    they equal the one-pass update of mean and variance. No change is given since a price of 0.
    """
    d, w = chunked(ticks, key, ts, tie, 1, size)
    d = d.withColumn("ret", returns(price, w))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    mine = F.when(F.col("_own"), F.col("ret"))
    past = earlier(d, key, _n=F.count("ret"), _s=F.sum("ret"), _m=F.var_pop("ret") * F.count("ret") + F.count("ret") * F.avg("ret") * F.avg("ret"))
    d = d.withColumns({"_k": F.count(mine).over(run), "_avg": F.coalesce(F.avg(mine).over(run), F.lit(0.0)), "_var": F.coalesce(F.var_pop(mine).over(run), F.lit(0.0))}).where("_own").join(past, [key, "_chunk"])
    d = d.withColumn("n", F.col("_n").cast("long") + F.col("_k"))
    d = d.withColumn("mean", F.when(F.col("n") > 0, (F.col("_s") + F.col("_k") * F.col("_avg")) / F.nullif("n", F.lit(0))))
    old = F.when(F.col("_n") > 0, F.col("_s") / F.nullif("_n", F.lit(0.0))).otherwise(0.0)
    square = F.greatest(F.lit(0.0), F.col("_m") - F.col("_n") * old * old) + F.col("_k") * F.col("_var") + F.when(F.col("n") > 0, F.col("_n") * F.col("_k") / F.nullif("n", F.lit(0)) * (F.col("_avg") - old) * (F.col("_avg") - old)).otherwise(0.0)
    # nothing is said before five returns; the variance has a floor
    d = d.withColumn("std", F.when(F.col("n") >= 5, F.sqrt(F.greatest(square / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(1e-12))))).drop("_k", "_avg", "_var", "_n", "_s", "_m")
    d = d.withColumn("z", F.abs(F.col("ret") - F.col("mean")) / F.col("std"))
    d = d.withColumn("prob", F.when(F.col("z").isNull(), 0.0).otherwise(F.least(F.lit(1.0), HAZARD * (1 + F.col("z") * F.col("z") / 2))))
    d = d.withColumn("flag", (F.col("prob") > CP_PROBABILITY) | F.coalesce(F.col("z") > CP_Z, F.lit(False)))
    return d.withColumn("stressed", F.coalesce(F.col("std") * F.sqrt(F.lit(252.0)) * 100 > REGIME_VOL, F.lit(False)))


def since_flagged(flagged: DataFrame, key: str = "instrument", price: str = "price") -> DataFrame:
    """Rows of ``changepoints`` with ``pct_since``: percent from the flagged price before to this flagged one."""
    mark = F.when(F.col("flag"), F.col(price))
    last = flagged.groupBy(key, "_chunk").agg(F.max_by(mark, F.when(F.col("flag"), F.col("_at"))).alias("_last"))
    over = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(key, "_chunk", F.last("_last", ignorenulls=True).over(over).alias("_last"))
    inside = F.last(mark, ignorenulls=True).over(Window.partitionBy(key, "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    d = flagged.withColumn("_prev", inside).join(carried, [key, "_chunk"])
    return d.withColumn("pct_since", F.when(F.col("flag"), (F.col(price) / F.nullif(F.coalesce("_prev", "_last"), F.lit(0.0)) - 1) * 100)).drop("_prev", "_last")


def war_premium(ticks: DataFrame, key: str = "instrument", ts: str = "ts", tie: str = "event_id", price: str = "price", size: int = CHUNK) -> DataFrame:
    """Root mean square of the last 19 returns over 0.01, less 1, within 0..1; 0 before ten prices.

    Prices that are not positive have no return, here and to the next price.
    """
    d, w = chunked(ticks, key, ts, tie, 19, size)
    d = d.withColumn("ret", F.when((F.lag(price).over(w) > 0) & (F.col(price) > 0), returns(price, w))).withColumn("seen", F.col("_at") + 1)
    vol = F.sqrt(F.avg(F.col("ret") * F.col("ret")).over(w.rowsBetween(-18, 0)))
    d = d.withColumn("premium", F.when((F.col("seen") >= 10) & vol.isNotNull(), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), vol / 0.01 - 1)), 4)).otherwise(0.0))
    return own(d)


def gaps(pings: DataFrame, key: str, ts: str, tie: str, speed: str, size: int = CHUNK, ttl_h: float | None = None) -> DataFrame:
    """Silence before each position in hours, spread of the last 50 speeds, anomaly score, dark flag.

    With ``ttl_h`` a key is new after a longer silence: no silence is given then, and earlier speeds don't count.
    """
    d, w = chunked(pings, key, ts, tie, 50, size)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    d = d.withColumn("gap_h", (micros - F.lag(micros).over(w)) / 3.6e9)
    if ttl_h is not None:
        d = d.withColumn("_life", F.count_if(F.col("gap_h") > ttl_h).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("gap_h", F.when(F.col("gap_h") <= ttl_h, F.col("gap_h")))
        w = Window.partitionBy(key, "_chunk", "_life").orderBy("_at")
    d = own(d.withColumn("speed_std", F.when(F.count(speed).over(w.rowsBetween(-49, 0)) >= 3, F.stddev_pop(speed).over(w.rowsBetween(-49, 0))))).drop("_life")
    gap, std = F.coalesce("gap_h", F.lit(0.0)), F.coalesce("speed_std", F.lit(0.0))
    score = 0.45 * F.least(gap / 24, F.lit(1.0)) + 0.30 * F.least(std / 5, F.lit(1.0)) + F.when(F.col("monitored"), 0.25).otherwise(0.0)
    return d.withColumn("score", F.round(score, 6)).withColumn("dark", (gap >= 4) & F.col("monitored")).withColumn("candidate", (gap >= 2) & F.col("monitored"))


def premium_on_base(ticks: DataFrame, alarm: float, key: str = "instrument", ts: str = "ts", tie: str = "event_id", price: str = "price", rows: int = 30, size: int = CHUNK) -> DataFrame:
    """``base``, the mean of the ``rows`` prices before, and ``ever``: a price up to now was ``alarm`` or more."""
    d, w = chunked(ticks, key, ts, tie, rows, size)
    d = own(d.withColumn("base", F.avg(price).over(w.rowsBetween(-rows, -1))))
    first = ticks.where(F.col(price) >= alarm).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(ts, tie)).alias("_first"))
    return d.join(first, F.col(key) == F.col("_key"), "left").withColumn("ever", F.coalesce(F.struct(ts, tie) >= F.col("_first"), F.lit(False))).drop("_key", "_first")


def cell(lat: Column, lon: Column) -> Column:
    """A grid cell of a tenth of a degree."""
    return F.concat(F.lit("fallback_"), F.round(lat * 10).cast("long").cast("string"), F.lit("_"), F.round(lon * 10).cast("long").cast("string"))


def valid_position(vessel: Column, lat: Column, lon: Column) -> Column:
    """Whether a position is of a vessel with a number and not at 0, 0, which is what a receiver without a fix sends."""
    return (F.trim(F.coalesce(vessel, F.lit(""))) != "") & F.coalesce(~((lat == 0) & (lon == 0)), F.lit(False))


def tone_delta(rows: DataFrame, key: str, ts: str, tie: str, tone: str, last: int | None = 20, size: int = CHUNK) -> DataFrame:
    """Tone less the mean of the ``last`` tones before it (all of them if None); 0 without history."""
    if last is not None:
        d, w = chunked(rows, key, ts, tie, last, size)
        return own(d.withColumn("delta", F.col(tone) - F.coalesce(F.avg(tone).over(w.rowsBetween(-last, -1)), F.col(tone))))
    d, w = chunked(rows, key, ts, tie, 0, size)
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    # the sum is rounded, so that the mean doesn't depend on the order in which it was summed
    n, total = F.count(tone).over(w) + F.col("_n"), F.round(F.coalesce(F.sum(tone).over(w), F.lit(0.0)) + F.col("_s"), 6)
    d = d.join(earlier(d, key, _n=F.count(tone), _s=F.sum(tone)), [key, "_chunk"]).withColumn("delta", F.col(tone) - F.coalesce(F.when(n > 0, total / F.nullif(n, F.lit(0.0))), F.col(tone)))
    return own(d.drop("_n", "_s"))


def carried(rows: DataFrame, key: str, ts: str, tie: str, mark: Column, size: int = CHUNK) -> DataFrame:
    """``before`` and ``after``: the last mark up to a row and the first one behind it, in the key's order.

    ``mark`` is a struct that is null on rows without one. Within a chunk windows find the marks; the first and the
    last one of each chunk are carried over the chunks in between, in both directions.
    """
    d, w = chunked(rows.withColumn("_mark", mark), key, ts, tie, 0, size)
    d = d.withColumn("_in", F.last("_mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # read from the end, since a frame to the end of the window is summed up anew for every row
    back = Window.partitionBy(key, "_chunk").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_out", F.last("_mark", ignorenulls=True).over(back))
    place = F.when(F.col("_mark").isNotNull(), F.col("_at"))
    ends = d.groupBy(key, "_chunk").agg(F.max_by("_mark", place).alias("_last"), F.min_by("_mark", place).alias("_first"))
    over = Window.partitionBy(key).orderBy("_chunk")
    ends = ends.select(key, "_chunk", F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_last"), F.last("_first", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)).alias("_first"))
    d = d.join(ends, [key, "_chunk"]).withColumn("before", F.coalesce("_in", "_last")).withColumn("after", F.coalesce("_out", "_first"))
    return own(d.drop("_mark", "_in", "_out", "_last", "_first"))


def as_of(rows: DataFrame, marks: DataFrame, key: str, t: str, value: str, size: int = CHUNK) -> DataFrame:
    """Each row with the mark before and after it and the value interpolated between them, by one union."""
    both = rows.select(key, t, "id", F.lit(None).cast("double").alias("m")).unionByName(marks.select(key, t, F.lit(None).cast("long").alias("id"), F.col(value).alias("m")))
    # of one time, marks come before rows
    both = both.withColumn("_ts", F.timestamp_seconds(F.col(t))).withColumn("_tie", F.struct(F.col("id").isNotNull().alias("row"), "id", "m"))
    d = carried(both, key, "_ts", "_tie", F.when(F.col("m").isNotNull(), F.struct(F.col(t).alias("t"), "m")), size).where("id is not null")
    a, b = F.col("after"), F.col("before")
    part = (F.col(t) - b["t"]) / (a["t"] - b["t"])
    days = (F.col(t) - b["t"]) / 86400
    value_ = F.when(a.isNotNull() & b.isNotNull(), b["m"] + (a["m"] - b["m"]) * part).when(b.isNotNull(), b["m"] * F.exp(-days / 7)).otherwise(0.0)
    return d.select(key, "id", value_.alias("value"))


def deferred(rows: DataFrame, extras: int = 20) -> DataFrame:
    """One batch an entity and day (days turn at 23:50): the anchor and up to ``extras`` further ids."""
    day = F.date_trunc("day", F.col("ts") + F.expr("interval 10 minutes"))
    order = F.struct((~F.col("force")).alias("f"), "prio", "ts", "event_id")
    g = rows.groupBy("entity", day.alias("day")).agg(F.min_by("event_id", order).alias("anchor"), F.count("*").alias("n"))
    return g.select("entity", "day", "anchor", F.least(F.col("n") - 1, F.lit(extras)).alias("extras"))


def hourly_budget(rows: DataFrame, ts: str, tie: str, limit: int = 10) -> DataFrame:
    """The first ``limit`` rows of each clock hour."""
    w = Window.partitionBy(F.date_trunc("hour", ts)).orderBy(ts, tie)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")
