"""Disruption cascades as window and array expressions: one row a scenario in, one row a day out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import BARRELS_PER_TONNE, GLOBAL_SUPPLY, POLICY_DRAW, SCENARIO, STRAIT_FLOW


def scenarios(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Scenario rows over the defaults; unknown keys are ignored."""
    full = [SCENARIO | {k: v for k, v in r.items() if k in SCENARIO} | {"scenario": r["scenario"]} for r in rows]
    kind = {str: "string", int: "int", float: "double"}
    schema = "scenario string, " + ", ".join(f"{k} {kind[type(v)]}" for k, v in SCENARIO.items())
    return spark.createDataFrame([tuple([r["scenario"], *[type(SCENARIO[k])(r[k]) for k in SCENARIO]]) for r in full], schema)


def severity() -> Column:
    c, t = F.col, F.col("day")
    days = c("days").cast("double")
    return F.when(t >= c("days"), 0.0).when(c("profile") == "escalating", F.least(F.lit(1.0), (t + 1) / F.greatest(days * 0.5, F.lit(1.0)))).when(c("profile") == "resolving", F.greatest(F.lit(0.0), 1 - t / F.greatest(days, F.lit(1.0)))).otherwise(1.0)


def daily(sc: DataFrame) -> DataFrame:
    """(scenario, day, net, draw, gap, reserve and cumulated gap) of each day.

    The reserve's draw-down is a recurrence with a closed form: what is left is the start less
    the sum of daily wishes, floored, so windows do for the loop.
    """
    c = F.col
    used = c("consumption") * (1 - c("demand_cut"))
    d = sc.withColumn("used", used).withColumn("day", F.explode(F.sequence(F.lit(0), c("horizon") - 1)))
    lost = c("used") * c("share_pct") / 100.0 * severity() * c("fraction")
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c("day") - c("ramp_days")) / F.greatest(c("ramp_days"), F.lit(1.0))))
    transit = F.greatest(F.lit(0.0), lost - F.least(c("bypass") * (1 - c("bypass_blocked")), lost) * ramp)
    d = d.withColumn("net", F.when(c("supply_cut") > 0, F.greatest(F.lit(0.0), c("supply_cut") * severity() * c("fraction"))).otherwise(transit))
    policy = F.coalesce(*[F.when(c("policy") == k, F.lit(v)) for k, v in POLICY_DRAW.items()], F.lit(1.0))
    start = c("spr_total") * c("spr_fill") * BARRELS_PER_TONNE
    floor = c("spr_floor_days") * c("used")
    w = Window.partitionBy("scenario").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("wish", F.least(c("spr_draw") * policy, c("net")))
    d = d.withColumn("left", start - F.least(F.greatest(F.lit(0.0), start - floor), F.sum("wish").over(w))).withColumn("floor", floor)
    before = F.coalesce(F.lag("left").over(Window.partitionBy("scenario").orderBy("day")), start)
    d = d.withColumn("gap", F.greatest(F.lit(0.0), c("net") - (before - c("left"))))
    return d.withColumn("cum_gap", F.sum("gap").over(w))


def summary(sc: DataFrame) -> DataFrame:
    """Headline figures of each scenario."""
    c = F.col
    d = daily(sc)
    horizon = F.first("horizon").cast("double")
    peak = F.max(F.round("net", 4))
    g = d.groupBy("scenario").agg(
        F.round(peak, 4).alias("gap"), F.count_if(F.round("net", 4) > 0.01).alias("gap_days"), F.round(F.sum(F.round("net", 4)), 4).alias("total"),
        F.coalesce(F.min(F.when((c("left") <= c("floor") + 1e-9) & (c("net") > 0), c("day"))).cast("double"), horizon).alias("spr_day"),
        F.coalesce(F.min(F.when((c("cum_gap") >= c("inventory_days") * c("used")) & (c("gap") > 0), c("day"))).cast("double"), horizon).alias("product_day"),
        *[F.first(x).alias(x) for x in ("supply_cut", "consumption", "import_pct", "fraction", "spare", "global_bypass", "price_low", "price_high", "gdp_per_usd", "cpi_per_usd")],
    )
    gross = F.when(c("supply_cut") > 0, c("supply_cut") / F.greatest(c("consumption") * c("import_pct") / 100.0 / GLOBAL_SUPPLY, F.lit(0.01)) * c("fraction")).otherwise(STRAIT_FLOW * c("fraction"))
    g = g.withColumn("gross", gross).withColumn("shock", F.greatest(F.lit(0.0), c("gross") - c("spare") - F.when(c("supply_cut") > 0, 0.0).otherwise(c("global_bypass"))))
    g = g.withColumn("price_lo", F.round(c("price_low") * c("shock"), 2)).withColumn("price_hi", F.round(c("price_high") * c("shock"), 2))
    mid = (c("price_lo") + c("price_hi")) / 2
    return g.withColumn("gdp_pct", F.round(mid * c("gdp_per_usd"), 3)).withColumn("cpi_pct", F.round(mid * c("cpi_per_usd"), 3))


def node_impacts(sc: DataFrame, plants: DataFrame) -> DataFrame:
    """Each plant's share of the gap by capacity times exposure: peak and first day above 0.001."""
    total = plants.agg(F.sum(F.col("capacity") * F.col("exposure")).alias("tw"))
    p = plants.crossJoin(F.broadcast(total)).withColumn("part", F.when(F.col("tw") > 0, F.col("capacity") * F.col("exposure") / F.col("tw")).otherwise(0.0))
    d = daily(sc).select("scenario", "day", "horizon", F.round("net", 4).alias("net")).crossJoin(F.broadcast(p)).withColumn("g", F.round(F.col("net") * F.col("part"), 6))
    return d.groupBy("scenario", "plant").agg(F.max("g").alias("peak"), F.coalesce(F.min(F.when(F.col("g") > 0.001, F.col("day"))).cast("double"), F.first("horizon").cast("double")).alias("onset"))


def agents(plants: DataFrame, bypass: float = 4.0, ramp_days: float = 5.0, fraction: float = 1.0, days: int = 30, horizon: int = 45) -> DataFrame:
    """(plant, day, gap): plants use up their stock, then share the bypass in proportion to need, then ration.

    A stock that only falls has a closed form, what it started with less all losses, floored at
    zero; a day's competition is a window over that day.
    """
    c = F.col
    d = plants.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    d = d.withColumn("loss", F.when(c("day") < days, c("capacity") * c("exposure") * fraction).otherwise(0.0))
    w = Window.partitionBy("plant").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("need_sum", F.greatest(F.lit(0.0), F.sum("loss").over(w) - c("stock")))
    d = d.withColumn("need", c("need_sum") - F.coalesce(F.lag("need_sum").over(Window.partitionBy("plant").orderBy("day")), F.lit(0.0)))
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c("day") - ramp_days) / max(ramp_days, 1)))
    total = F.sum("need").over(Window.partitionBy("day"))
    d = d.withColumn("pool", bypass * ramp).withColumn("total", total)
    secured = F.when((c("total") > 0) & (c("pool") > 0), c("need") / c("total") * F.least("pool", "total")).otherwise(0.0)
    return d.withColumn("gap", F.greatest(F.lit(0.0), c("need") - secured))


def leontief(spark: SparkSession, sectors: list[str], a: list[list[float]], petroleum: list[float], terms: int = 40) -> DataFrame:
    """(sector, multiplier, quantity, price): effects of a unit shock, by the Neumann series of an n x n matrix.

    The matrix is a table of the economy's sectors, a few dozen at most; numpy does it on the driver.
    """
    import numpy as np

    m, p = np.array(a), np.array(petroleum)
    if max(abs(np.linalg.eigvals(m))) >= 1:
        raise ValueError("the series does not converge")
    inv, power = np.eye(len(sectors)), np.eye(len(sectors))
    for _ in range(terms):
        power = power @ m
        inv += power
    rows = [(s, float(x), float(y), float(z)) for s, x, y, z in zip(sectors, inv.sum(axis=0), inv @ p, inv.T @ p)]
    return spark.createDataFrame(rows, "sector string, multiplier double, quantity double, price double")
