"""Reserve planning: the value of waiting, and a constrained dynamic program as array folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BBL_TO_MMT, SDP_ACTIONS, SDP_DISCOUNT, SDP_LEVELS


def option_value(p: Column, days: Column, premium: Column, gap: Column, price: Column, destruction: float = 0.3) -> Column:
    """Saving from waiting ``days`` before drawing; positive means wait. 0 without a gap or a wait."""
    volume = gap * BBL_TO_MMT * 1e6 * days
    now = price / (BBL_TO_MMT * 1e6) * volume
    wait = p * now * destruction + (1 - p) * (now * destruction + now + now * premium)
    return F.when((gap <= 0) | (days <= 0), F.lit(0.0)).otherwise(F.round(now - wait, 2))


#: Folds over a scenario row with s0, cons, gap_mmt, price, lam, gap_days, horizon, buffer_days, draw_fraction.
#: Levels are an even grid; a next state is rounded up to a level.
_STEP = "rmax / {n}".format(n=SDP_LEVELS - 1)
_NEXT = f"least({SDP_LEVELS - 1}, greatest(0, cast(ceil(least({{res}}, rmax) / ({_STEP}) - 1e-9D) as int)))"


def _total(level: str, frac: float, v: str, t: str) -> str:
    draw = f"(maxdraw * {frac}D)"
    res = f"greatest(0D, {level} - {draw})"
    reward = f"-(greatest(0D, if({t} < gap_days, gap_mmt, 0D) - {draw}) * price / {BBL_TO_MMT}D * 0.000001D) - if({res} < buf, lam, 0D)"
    return f"if({draw} > {level} + 1e-9D, -1e18D, {reward} + {SDP_DISCOUNT}D * {v}[{_NEXT.format(res=res)}])"


def prepared(df: DataFrame) -> DataFrame:
    c = F.col
    df = df.withColumn("buf", c("buffer_days") * c("cons"))
    df = df.withColumn("rmax", F.greatest(c("s0") * 1.5, c("buf") * 2.5))
    return df.withColumn("maxdraw", F.least(c("gap_mmt"), c("cons") * c("draw_fraction")))


def value_function(df: DataFrame) -> DataFrame:
    """``v0``: value at each level on the first day, by backward induction; one array fold a scenario."""
    best = ", ".join(_total(f"(li * {_STEP})", a, "v", "t") for a in SDP_ACTIONS)
    fold = f"aggregate(reverse(sequence(0, horizon - 1)), array_repeat(0D, {SDP_LEVELS}), (v, t) -> transform(sequence(0, {SDP_LEVELS - 1}), li -> array_max(array({best}))))"
    return prepared(df).withColumn("v0", F.expr(fold))


def plan(df: DataFrame) -> DataFrame:
    """(scenario, day, volume, reserve, unmet): forward pass over the stored value functions of every day."""
    best = ", ".join(_total(f"(li * {_STEP})", a, "s[0]", "t") for a in SDP_ACTIONS)
    values = f"aggregate(reverse(sequence(0, horizon - 1)), array(array_repeat(0D, {SDP_LEVELS})), (s, t) -> concat(array(transform(sequence(0, {SDP_LEVELS - 1}), li -> array_max(array({best})))), s))"
    # choices are made at the level above the reserve, as the values were; ties go to the smaller draw
    lvl = f"({_NEXT.format(res='s.r')} * {_STEP})"
    picks = ", ".join(f"named_struct('q', {_total(lvl, a, 'vs[t + 1]', 't')}, 'i', -{i}, 'd', maxdraw * {a}D)" for i, a in enumerate(SDP_ACTIONS))
    draw = f"least(array_max(array({picks})).d, s.r)"
    walk = f"""aggregate(sequence(0, horizon - 1), named_struct('r', s0, 'out', cast(array() as array<struct<day: int, volume: double, reserve: double, unmet: double>>)),
      (s, t) -> transform(array({draw}), d -> named_struct('r', greatest(0D, s.r - d), 'out', concat(s.out, array(named_struct('day', t + 1, 'volume', d, 'reserve', greatest(0D, s.r - d), 'unmet', greatest(0D, if(t < gap_days, gap_mmt, 0D) - d))))))[0]).out"""
    return prepared(df).withColumn("vs", F.expr(values)).withColumn("days", F.expr(walk)).select("scenario", "buf", F.inline("days"))


def plan_summary(days: DataFrame) -> DataFrame:
    return days.groupBy("scenario").agg(F.sum("volume").alias("drawn"), F.count_if(F.col("volume") > 1e-6).alias("draw_days"), F.max("unmet").alias("peak_unmet"), (1 - F.count_if(F.col("reserve") < F.col("buf")) / F.count("*")).alias("prob"))
