"""Learned models; without SQL."""

from __future__ import annotations

import random
from multiprocessing.pool import ThreadPool

from pyspark.sql import functions as F

from ..operators import boosting, fusion, models, scenario
from ..operators.signals import ahead
from ..sources.views import signals
from ..workspace import Workspace
from .registry import query
from .risk import BATCH_SQL


def states(spark, sf_dir):
    """An entity's batches with ``y``: whether its score is elevated."""
    f = fusion.fuse_consumer(fusion.features(fusion.flushes(signals(spark, sf_dir)), "entity", "flush"))
    return Workspace(spark, "states").save(f.withColumn("y", (F.col("score") >= 0.18).cast("int")))


@query("gbt_loco")
def gbt_loco(spark, sf_dir):
    """Probability that an entity's next batch is elevated, each region's rows scored by the others' model: 18 fits of 200 trees."""
    f = states(spark, sf_dir)
    d, w = ahead(f, "entity", "observed_at", "flush")
    rows = d.withColumn("y", F.lead("y").over(w)).where("_own and y is not null").withColumn("crisis", F.col("entity") % 3).select("entity", "flush", "crisis", "y", *fusion.FEATURES)
    out = models.leave_one_out(Workspace(spark, "labelled").save(rows), fusion.FEATURES, "y", "crisis")
    return out.select("entity", "flush", "crisis", "y", F.round("probability_", 6).alias("probability"))


#: The features of each stream.
STREAMS = {f"factor_{name}": [c for c in fusion.FEATURES if c.startswith(heads)] for name, heads in (("ais", ("ais_",)), ("gdelt", ("gdelt_", "news_")), ("price", ("price_",)), ("sanctions", ("sanctions_",)))}
_WEIGHTS = (("ais", 0.30), ("gdelt", 0.30), ("price", 0.25), ("sanctions", 0.15))


@query("stream_attributions", BATCH_SQL + """,
c AS (SELECT entity, flush, score, m, round(least(1, """ + " + ".join(f"CASE WHEN m & {1 << i} > 0 THEN {w}::DOUBLE * factor_{n} ELSE 0 END" for i, (n, w) in enumerate(_WEIGHTS)) + """), 9) AS v FROM scored, range(16) r(m))
SELECT CAST(entity AS INTEGER) AS entity, flush, score, """ + ", ".join(f"round(sum(CASE WHEN m & {1 << i} > 0 THEN v ELSE -v END / CASE bit_count(m & {15 - (1 << i)}) WHEN 0 THEN 4 WHEN 3 THEN 4 ELSE 12 END) + 3e-8::DOUBLE, 5) AS factor_{n}" for i, (n, _) in enumerate(_WEIGHTS)) + " FROM c GROUP BY entity, flush, score")
def stream_attributions(spark, sf_dir):
    """Shapley values of the four streams of the weighted fusion, over a row of zeros; where the score's cap holds they differ from the weighted factors."""
    f = fusion.features(fusion.flushes(signals(spark, sf_dir)), "entity", "flush").withColumn("id", F.struct("entity", "flush"))
    got = models.attributions(f, "id", STREAMS, dict.fromkeys(fusion.FEATURES, 0.0), fusion.fuse_consumer, "score")
    # a little is added so that halves are rounded alike
    return got.select("id.entity", "id.flush", "score", *[F.round(F.col(c) + 3e-8, 5).alias(c) for c in STREAMS])


@query("gbt_attributions")
def gbt_attributions(spark, sf_dir):
    """Shapley values of the streams for a calibrated model's probabilities, over the mean row."""
    f = states(spark, sf_dir).withColumn("id", F.struct("entity", "flush"))
    model, platt = models.classifier(f, fusion.FEATURES, "y")
    base = f.agg(*[F.avg(c).alias(c) for c in fusion.FEATURES]).first().asDict()
    got = models.attributions(f.select("id", *fusion.FEATURES), "id", STREAMS, base, lambda d: models.probabilities(d, model, platt))
    return got.select("id.entity", "id.flush", *[F.round(F.col(c), 6).alias(c) for c in ("score", "base", *STREAMS)])


@query("feature_attributions")
def feature_attributions(spark, sf_dir):
    """Shapley values of the 17 features for a boosted model's margins, and their sums by stream."""
    f = states(spark, sf_dir)
    (model,) = boosting.fit(f, fusion.FEATURES, "y", [F.lit(True)])
    got = boosting.attributed(f, model, ["entity", "flush"])
    streams = [F.round(sum(F.col(f"phi_{c}") for c in columns), 6).alias(name) for name, columns in STREAMS.items()]
    return got.select("entity", "flush", *[F.round(c, 6).alias(c) for c in ("margin", "base", *(f"phi_{c}" for c in fusion.FEATURES))], *streams)


#: What the surrogate varies, as (low, high), and what it predicts.
VARIED = {"fraction": (0.05, 1.0), "days": (5, 90), "spr_fill": (0.15, 1.0), "bypass": (2.0, 5.5), "ramp_days": (2.0, 12.0), "inventory_days": (10.0, 30.0)}
TARGETS = ["gap", "gap_days", "spr_day", "price_lo", "price_hi", "gdp_pct"]


@query("surrogate")
def surrogate(spark, sf_dir):
    """Forests that stand in for the cascade: 5000 drawn scenarios, six inputs, six targets, 150 trees each; a fifth is held out."""
    r = random.Random(7)
    rows = [{"scenario": f"s{i}"} | {k: r.randint(a, b) if k == "days" else r.uniform(a, b) for k, (a, b) in VARIED.items()} for i in range(5000)]
    sc = scenario.scenarios(spark, rows)
    data = scenario.summary(sc).select("scenario", *TARGETS).join(sc.select("scenario", *VARIED), "scenario").withColumn("held_out", F.pmod(F.xxhash64("scenario"), F.lit(5)) == 0).cache()
    train = data.where("not held_out")
    with ThreadPool(models.PARALLEL) as pool:
        fitted = pool.map(lambda t: models.surrogate(train, list(VARIED), t), TARGETS)
    out = data
    for model in fitted:
        out = models.predict(model, list(VARIED), out).drop("x")
    return out.select("scenario", "held_out", *TARGETS, *[F.round(f"{t}_hat", 6).alias(f"{t}_hat") for t in TARGETS])
