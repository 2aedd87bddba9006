"""Grades, routes and multi-criteria ranking of procurement options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BERTH_WAIT_DAYS, BRENT, CARGO_BBL, DEMURRAGE_PER_DAY, RISK_MAX, TANKER_PENALTY_DAYS, TOPSIS_WEIGHTS, WAR_PER_UNIT


def delay(congestion: Column) -> Column:
    return F.round(congestion * BERTH_WAIT_DAYS, 2)


def demurrage(days: Column) -> Column:
    return F.round(days * DEMURRAGE_PER_DAY / CARGO_BBL, 4)


def war_premium(risk: Column) -> Column:
    return F.greatest(F.lit(0.0), risk - 0.3) / 0.5 * WAR_PER_UNIT


def best_routes(suppliers: DataFrame, bypasses: DataFrame, corridors: DataFrame, congestion: DataFrame, risk_max: float = RISK_MAX) -> DataFrame:
    """The cheapest open route of each supplier.

    suppliers: supplier, corridor, freight, base_days, availability; bypasses: supplier, corridor,
    premium, added_days; corridors: corridor, risk (null counts as 0; a corridor that is missing has
    risk 0.1 and no war premium); congestion: one row, congestion. Ties go to the first candidate.
    """
    c = F.col
    base = suppliers.select("supplier", "corridor", "freight", "base_days", "availability", F.lit(0.0).alias("premium"), F.lit(0.0).alias("added_days"), F.lit(0).alias("seq"))
    more = bypasses.join(suppliers.drop("corridor"), "supplier").select("supplier", "corridor", "freight", "base_days", "availability", "premium", "added_days", F.lit(1).alias("seq"))
    j = base.unionByName(more).join(corridors.select("corridor", F.coalesce("risk", F.lit(0.0)).alias("known")), "corridor", "left").crossJoin(F.broadcast(congestion))
    j = j.withColumn("risk", F.coalesce("known", F.lit(0.1))).where((c("known").isNull() | (c("risk") <= risk_max)))
    war = F.when(c("known").isNull() & (c("seq") == 0), 0.0).otherwise(war_premium(c("risk")))
    wait = delay(c("congestion"))
    tanker = F.round(TANKER_PENALTY_DAYS * F.greatest(F.lit(0.0), 1 - c("availability")), 2)
    j = j.withColumn("landed", F.round(BRENT + c("freight") + c("premium") + war + demurrage(wait), 2)).withColumn("lead", F.round(c("base_days") + c("added_days") + wait + tanker, 1))
    return j.groupBy("supplier").agg(F.min(F.struct("landed", "seq", "corridor", "lead", "risk")).alias("b")).select("supplier", "b.corridor", "b.landed", "b.lead", "b.risk", (c("b.seq") == 1).alias("bypass"))


def topsis(options: DataFrame, key: str) -> DataFrame:
    """Ranked options (cost, lead, compat, risk): min-max scaled, weighted distances to the best and worst.

    The extremes are one aggregate that is broadcast; nothing is sorted in one task but the caller's top.
    """
    names = list(TOPSIS_WEIGHTS)
    ends = options.agg(*[f(n).alias(f"{n}_{k}") for n in names for f, k in ((F.min, "lo"), (F.max, "hi"))], F.count("*").alias("n"))
    o = options.crossJoin(F.broadcast(ends))
    unit = {n: F.when(F.col(f"{n}_hi") == F.col(f"{n}_lo"), 0.5).otherwise((F.col(n) - F.col(f"{n}_lo")) / (F.col(f"{n}_hi") - F.col(f"{n}_lo"))) for n in names}
    o = o.withColumns({f"u_{n}": x for n, x in unit.items()})

    def distance(best: bool) -> Column:
        total = F.lit(0.0)
        for n, w in TOPSIS_WEIGHTS.items():
            goal = 1.0 if (n == "compat") == best else 0.0
            total = total + w * (F.col(f"u_{n}") - goal) * (F.col(f"u_{n}") - goal)
        return F.sqrt(total)

    good, bad = distance(True), distance(False)
    score = F.when(F.col("n") == 1, 1.0).when(good + bad > 0, F.round(bad / (good + bad), 4)).otherwise(0.5)
    return o.select(key, *names, score.alias("score"), *[F.round(F.col(f"u_{n}") if n == "compat" else 1 - F.col(f"u_{n}"), 4).alias(f"{n}_score") for n in names])


def best_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
