"""Learned risk models: boosted trees with calibrated probabilities, and a regression surrogate on spark.ml."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import boosting
from .boosting import Boosted


#: Fits of the surrogate that run side by side.
PARALLEL = 6


def classifiers(rows: DataFrame, columns: list[str], label: str, parts: list[Column], trees: int = 200, depth: int = 4, rate: float = 0.05, folds: int = 5) -> list[tuple[Boosted, tuple[float, float]]]:
    """(model, calibrator) for each of ``parts``, a condition on the rows it learns from; all fits grow together.

    The calibrator is a logistic curve through the margins of trees that had not seen the row: each part is fitted
    once more without each of ``folds`` folds of its rows.
    """
    work = Workspace(rows.sparkSession, "classifiers")
    data = work.save(rows.withColumn("_fold", F.pmod(F.xxhash64(*columns), F.lit(folds))).withColumns({f"_part{g}": F.coalesce(p, F.lit(False)) for g, p in enumerate(parts)}).where(F.col(label).isNotNull()))
    use = [F.col(f"_part{g}") & (F.lit(True) if k == folds else F.col("_fold") != k) for g in range(len(parts)) for k in range(folds + 1)]
    fitted = boosting.fit(data, columns, label, use, trees, depth, rate)
    at = lambda g, k: fitted[g * (folds + 1) + k]
    unseen_by = {f"_m{g}_{k}": F.col(f"_part{g}") & (F.col("_fold") == k) for g in range(len(parts)) for k in range(folds)}
    seen = boosting.margins(data, {f"_m{g}_{k}": at(g, k) for g in range(len(parts)) for k in range(folds)}, unseen_by)
    unseen = work.save(seen.select(F.col(label).cast("double").alias("y"), *[F.coalesce(*[F.col(f"_m{g}_{k}") for k in range(folds)]).alias(f"m{g}") for g in range(len(parts))]))
    return [(at(g, folds), curve) for g, curve in enumerate(boosting.platts(unseen, [f"m{g}" for g in range(len(parts))], "y"))]


def classifier(rows: DataFrame, columns: list[str], label: str, **kw) -> tuple[Boosted, tuple[float, float]]:
    return classifiers(rows, columns, label, [F.lit(True)], **kw)[0]


def probabilities(rows: DataFrame, model: Boosted, platt: tuple[float, float]) -> DataFrame:
    return boosting.margins(rows, {"_margin": model}).withColumn("probability_", 1 / (1 + F.exp(-(F.col("_margin") * platt[0] + platt[1])))).drop("_margin")


def leave_one_out(rows: DataFrame, columns: list[str], label: str, group: str, **kw) -> DataFrame:
    """Probabilities of each group's rows from a model of all other groups; groups are a few crises."""
    groups = [r[0] for r in rows.select(group).distinct().where(F.col(group).isNotNull()).orderBy(group).collect()]
    fitted = classifiers(rows, columns, label, [F.col(group) != g for g in groups], **kw)
    scored = boosting.margins(rows, {f"_m{i}": model for i, (model, _) in enumerate(fitted)}, {f"_m{i}": F.col(group) == g for i, g in enumerate(groups)})
    own = F.coalesce(*[F.when(F.col(group) == g, F.col(f"_m{i}") * a + b) for i, (g, (_, (a, b))) in enumerate(zip(groups, fitted))], F.lit(None).cast("double"))
    return scored.withColumn("probability_", 1 / (1 + F.exp(-own))).drop(*[f"_m{i}" for i in range(len(groups))])


def attributions(rows: DataFrame, key: str, streams: dict[str, list[str]], base: dict[str, float], score: Callable[[DataFrame], DataFrame], out: str = "probability_") -> DataFrame:
    """(key, score, base, one column a stream): exact Shapley values of groups of features.

    A coalition's value is the model's score with the features outside it at their ``base`` values,
    so each row is scored 2 ** streams times. The values of a row add up to its score less the
    score of the base row.
    """
    names = list(streams)
    n = len(names)
    mask = F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1)))
    d = rows.withColumn("_mask", mask)
    for i, stream in enumerate(names):
        for c in streams[stream]:
            d = d.withColumn(c, F.when(F.col("_mask").bitwiseAND(1 << i) != 0, F.col(c)).otherwise(F.lit(float(base[c]))))
    scored = score(d)
    parts = []
    for i, stream in enumerate(names):
        size = F.bit_count(F.col("_mask").bitwiseAND(~(1 << i)))
        weight = F.coalesce(*[F.when(size == k, F.lit(math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n))) for k in range(n)])
        parts.append(F.sum(F.when(F.col("_mask").bitwiseAND(1 << i) != 0, weight).otherwise(-weight) * F.col(out)).alias(stream))
    whole = F.max(F.when(F.col("_mask") == (1 << n) - 1, F.col(out))).alias("score")
    none = F.max(F.when(F.col("_mask") == 0, F.col(out))).alias("base")
    return scored.groupBy(key).agg(whole, none, *parts)


def importances(model: Boosted) -> list[tuple[str, float]]:
    return model.gains()


def surrogate(rows: DataFrame, inputs: list[str], target: str, trees: int = 150):
    """A forest that stands in for the cascade: it predicts ``target`` as <target>_hat."""
    data = VectorAssembler(inputCols=inputs, outputCol="x").transform(rows)
    return RandomForestRegressor(featuresCol="x", labelCol=target, numTrees=trees, seed=7, predictionCol=f"{target}_hat").fit(data)


def predict(model, inputs: list[str], rows: DataFrame) -> DataFrame:
    return model.transform(VectorAssembler(inputCols=inputs, outputCol="x").transform(rows))


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> RandomForestRegressionModel | None:
    """A saved surrogate; None where there is none, so that the caller falls back on the exact cascade."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return RandomForestRegressionModel.load(path)
