"""Predictions against outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, axes: dict[str, tuple[str, str]], *by: str) -> DataFrame:
    """Error metrics of each axis {name: (predicted, realized)}, in one aggregation."""
    parts = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(p).alias("p"), F.col(r).alias("r")) for a, (p, r) in axes.items()])
    u = rows.select(*by, F.inline(parts))
    d = F.col("p") - F.col("r")
    return u.groupBy(*by, "axis").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(d) / F.abs("r")) * 100, 6).alias("mape"), F.round(F.avg(2 * F.abs(d) / (F.abs("p") + F.abs("r"))) * 100, 6).alias("smape"),
        F.round(F.avg(F.abs(d)), 6).alias("mae"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"), F.round(F.avg(-d), 6).alias("bias"))


def calibration(rows: DataFrame, predicted: str, realized: str, least: int = 20) -> DataFrame:
    """Mean ratio of outcome to prediction by entity with at least ``least`` rows, within 0.5 to 1.5."""
    g = rows.groupBy("entity").agg(F.avg(F.col(realized) / F.col(predicted)).alias("f"), F.count("*").alias("n")).where(F.col("n") >= least)
    return g.select("entity", F.least(F.lit(1.5), F.greatest(F.lit(0.5), F.col("f"))).alias("factor"))


def traces(runs: DataFrame, events: DataFrame, slack: float, bin_s: int) -> DataFrame:
    """(run, traced): events of a run's user within its time. The interval join goes by user and time bin."""
    r = runs.withColumn("bin", F.explode(F.sequence(F.floor(F.col("t0") / bin_s), F.floor((F.col("t1") + slack) / bin_s))))
    e = events.withColumn("bin", F.floor(F.col("t") / bin_s))
    hit = r.join(e, ["u", "bin"]).where((F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1") + slack)).groupBy("run").agg(F.count("*").alias("traced"))
    return runs.select("run").join(hit, "run", "left").withColumn("traced", F.coalesce("traced", F.lit(0)))


def roc(rows: DataFrame, bins: str = "x", parts: int = 64) -> DataFrame:
    """Area under the curve, best threshold and its J of (y, x).

    Rows are summed by score first; the distinct scores are then summed up part by part, between
    ``parts`` quantiles, and a part starts from the sums of the parts above it.
    """
    g = rows.groupBy(F.col(bins).alias("x")).agg(F.sum("y").alias("p"), (F.count("*") - F.sum("y")).alias("n"))
    t = g.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"), F.percentile_approx("x", [i / parts for i in range(1, parts)], F.lit(10_000)).alias("bounds"))
    c = g.crossJoin(F.broadcast(t)).withColumn("part", F.size(F.filter("bounds", lambda b: b <= F.col("x")))).drop("bounds")
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = c.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("n").alias("pn")).select("part", F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("pp"), F.coalesce(F.sum("pn").over(above), F.lit(0)).alias("pn"))
    w = Window.partitionBy("part").orderBy(F.desc("x"))
    c = c.join(sums, "part").withColumn("up", F.sum("p").over(w) + F.col("pp")).withColumn("down", F.sum("n").over(w) + F.col("pn"))
    c = c.select("x", (F.col("up") / F.nullif("tp", F.lit(0))).alias("tpr"), (F.col("down") / F.nullif("tn", F.lit(0))).alias("fpr"), ((F.col("up") - F.col("p")) / F.nullif("tp", F.lit(0))).alias("t0"), ((F.col("down") - F.col("n")) / F.nullif("tn", F.lit(0))).alias("f0"))
    j = F.col("tpr") - F.col("fpr")
    return c.agg(F.round(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2), 9).alias("auc"), F.max_by("x", F.struct(F.round(j, 9), "x")).alias("threshold"), F.round(F.max(j), 9).alias("j"))
