"""Values worked out by hand, and properties."""

import math

import pytest
from pyspark.sql import functions as F

from tideline.functions.scores import display_band, grade_compatibility, risk_band
from tideline.operators import fusion, graph, procurement, reserve, sandbox, scenario, upsert


def one(df):
    return df.collect()[0]


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.05, 0.10, 0.18, 0.2634, 0.29, 0.45, 0.70, 0.85)], "s double")
    got = [(r.a, r.b) for r in df.select(risk_band(F.col("s")).alias("a"), display_band(F.col("s")).alias("b")).collect()]
    assert got == [("calm", "CALM"), ("watch", "CALM"), ("elevated", "CALM"), ("action", "WATCH"), ("critical", "WATCH"), ("critical", "ELEVATED"), ("critical", "ACTION"), ("critical", "CRITICAL")]


def vector(spark, **kw):
    base = dict.fromkeys(fusion.FEATURES, 0.0) | kw
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} double" for k in base))


def test_fusion(spark):
    v = vector(spark, ais_dark_vessel_count=3.0, ais_gap_count_24h=5.0, gdelt_tone_24h_mean=-7.5, price_bocd_flag=1.0, sanctions_major_entity=1.0)
    r = one(fusion.fuse_consumer(v))
    assert [round(x, 4) for x in (r.factor_ais, r.factor_gdelt, r.factor_price, r.factor_sanctions, r.score)] == [0.60, 0.30, 0.35, 0.35, 0.41]
    r = one(fusion.fuse_sensory(v))
    assert [round(x, 5) for x in (r.factor_ais, r.factor_gdelt, r.factor_price, r.factor_sanctions)] == [0.1365, 0.09375, 0.10, 0.075] and round(r.score, 5) == 0.40525
    assert one(fusion.fuse_consumer(vector(spark))).score == 0.0 == one(fusion.fuse_sensory(vector(spark))).score


CASES = [
    ({}, 2.1888, 10, 7, 43.75, 75.0, -2.375, 2.078, 17.5103), ({"fraction": 0.0}, 0, 0, 45, 0, 0, 0, 0, 0), ({"bypass_blocked": 1.0}, 2.1888, 30, 7, 43.75, 75.0, -2.375, 2.078, 65.664),
    ({"profile": "escalating", "bypass_blocked": 0.9}, 1.7888, 30, 15, 43.75, 75.0, -2.375, 2.078, 41.5421), ({"profile": "resolving", "bypass_blocked": 0.9}, 2.1888, 25, 8, 43.75, 75.0, -2.375, 2.078, 26.0314),
]


def test_cascade(spark):
    rows = {r.scenario: r for r in scenario.summary(scenario.scenarios(spark, [c[0] | {"scenario": str(i)} for i, c in enumerate(CASES)])).collect()}
    for i, (_, gap, days, spr, lo, hi, gdp, cpi, total) in enumerate(CASES):
        r = rows[str(i)]
        assert abs(r.gap - gap) <= 1.1e-4 and r.gap_days == days and r.spr_day == spr and (r.price_lo, r.price_hi) == (lo, hi)
        assert abs(r.gdp_pct - gdp) < 1e-9 and abs(r.cpi_pct - cpi) < 1e-9 and abs(r.total - total) < 5e-3


def test_reserve_never_rises_and_blocked_bypass_never_helps(spark):
    d = scenario.daily(scenario.scenarios(spark, [{"scenario": "a"}, {"scenario": "b", "bypass_blocked": 1.0}])).orderBy("scenario", "day").collect()
    for s in "ab":
        left = [r.left for r in d if r.scenario == s]
        assert all(x >= y - 1e-12 for x, y in zip(left, left[1:]))
    assert sum(r.net for r in d if r.scenario == "b") >= sum(r.net for r in d if r.scenario == "a")


def test_option_value(spark):
    df = spark.createDataFrame([(0.55, 5.0, 1.0), (0.20, 5.0, 1.0), (0.05, 5.0, 1.0), (0.5, 5.0, 0.0)], "p double, d double, g double")
    got = [r[0] for r in df.select(reserve.option_value(F.col("p"), F.col("d"), F.lit(0.12), F.col("g"), F.lit(80.0))).collect()]
    want = [400 - (0.3 * 400 + (1 - p) * (400 + 48)) for p in (0.55, 0.20, 0.05)]
    assert all(math.isclose(a, b, abs_tol=0.01) for a, b in zip(got, [*want, 0.0]))


def test_plan(spark):
    cols = "scenario string, s0 double, cons double, gap_mmt double, price double, lam double, gap_days int, horizon int, buffer_days double, draw_fraction double"
    df = spark.createDataFrame([("a", 2.13, 0.56, 0.109, 80.0, 5.0, 30, 20, 2.0, 0.6), ("none", 2.13, 0.56, 0.0, 80.0, 0.0, 0, 10, 2.0, 0.6)], cols)
    days = reserve.plan(df).orderBy("scenario", "day").collect()
    a = [r for r in days if r.scenario == "a"]
    assert len(a) == 20 and all(x.reserve >= y.reserve - 1e-12 for x, y in zip(a, a[1:]))
    assert all(r.volume == 0 for r in days if r.scenario == "none")


def test_grades(spark):
    df = spark.createDataFrame([(32.8, 1.96, 32.0, 1.8, None), (16.0, 3.5, 40.0, 0.2, None), (1.0, 1.0, 2.0, 2.0, 0.77), (1.0, 1.0, None, None, None), (32.0, 1.8, 32.0, 1.8, None)], "a double, s double, ra double, rs double, k double")
    got = [r[0] for r in df.select(grade_compatibility(*(F.col(c) for c in ("a", "s", "ra", "rs", "k")))).collect()]
    assert got[2:] == [0.77, 0.5, 1.0] and 0 <= got[1] < got[0] <= 1


def test_topsis(spark):
    o = spark.createDataFrame([("good", 80.0, 10.0, 0.9, 0.1), ("bad", 100.0, 40.0, 0.3, 0.6)], "k string, cost double, lead double, compat double, risk double")
    assert {r.k: r.score for r in procurement.topsis(o, "k").collect()} == {"good": 1.0, "bad": 0.0}
    assert one(procurement.topsis(o.where("k = 'bad'"), "k")).score == 1.0


def test_routes(spark):
    s = spark.createDataFrame([("x", "strait", 1.8, 28.0, 1.0)], "supplier string, corridor string, freight double, base_days double, availability double")
    b = spark.createDataFrame([("x", "canal", 2.5, 2.0)], "supplier string, corridor string, premium double, added_days double")
    c = spark.createDataFrame([("strait", 0.9), ("canal", 0.1)], "corridor string, risk double")
    r = one(procurement.best_routes(s, b, c, spark.createDataFrame([(0.0,)], "congestion double")))
    assert (r.corridor, r.landed, r.lead, r.risk, r.bypass) == ("canal", 99.3, 30.0, 0.1, True)


def test_graph(spark):
    feeds = spark.createDataFrame([("h", "p1", 0.42), ("h", "p1", 0.1), ("h", "p2", 0.45)], "corridor string, port string, share double")
    supplies = spark.createDataFrame([("p1", "j", 0.70), ("p2", "j", 0.30)], "port string, plant string, share double")
    assert abs(one(graph.exposure(feeds, supplies)).exposure - 0.429) < 1e-12
    edges = spark.createDataFrame([(1, 2, 0.42), (2, 3, None)], "src int, dst int, share double")
    scores = spark.createDataFrame([(1, 0.9), (2, 0.0), (3, 0.0)], "node int, score double")
    got = {r.node: (r.hop, round(r.inherited, 6)) for r in graph.cascade(edges, scores).collect()}
    assert got == {2: (1, 0.378), 3: (2, 0.2268)}


def test_projection(spark):
    r = sandbox.project(spark.createDataFrame([("e", [1.0, 1.8, 2.6, 3.4])], "entity string, xs array<double>"), "xs", 10.0).orderBy("hours").collect()
    assert [round(x.median, 4) for x in r] == [4.2, 4.84, 5.352, 5.7616, 6.3514, 6.7289, 7.1251]
    assert [round(x.p10, 4) for x in r] == [3.5592, 3.9338, 4.2421, 4.48, 4.7818, 4.9165, 4.9053]


def test_numbering_equals_row_number(spark):
    rows = [(i % 3, i * 7919 % 500, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, m int, id int").select("k", F.timestamp_seconds(F.col("m") * 3600).alias("ts"), "id")
    from pyspark.sql import Window

    both = fusion.numbered(df, "k", "ts", "id").withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id")))
    assert both.where("rn <> want").count() == 0


def test_close_and_insert(spark):
    h = spark.createDataFrame([("a", 1, "2024-01-01", None)], "k string, v int, valid_at string, invalid_at string")
    u = spark.createDataFrame([("a", 2, "2024-01-05"), ("b", 1, "2024-01-06")], "k string, v int, valid_at string")
    got = sorted((r.k, r.v, r.invalid_at) for r in upsert.close_and_insert(h, u, "k").collect())
    assert got == [("a", 1, "2024-01-05"), ("a", 2, None), ("b", 1, None)]


@pytest.mark.parametrize("kind", ["crossing"])
def test_crossing_probability_is_one_when_base_is_high(spark, kind):
    bands = spark.createDataFrame([(1, h, 0.0, 0.0, 0.0, 0.0) for h in (6, 12)], "entity int, hours int, a10 double, a90 double, b10 double, b90 double")
    hi = one(sandbox.crossing(bands, spark.createDataFrame([(1, 0.5)], "entity int, base double")))
    lo = one(sandbox.crossing(bands, spark.createDataFrame([(1, 0.1)], "entity int, base double")))
    assert (hi.probability, hi.median_h) == (1.0, 6.0) and (lo.probability, lo.median_h) == (0.0, float("inf"))


def test_counterfactuals_never_raise_the_probability(spark):
    bands = spark.createDataFrame([(1, h, 1.0, 4.0, 0.2, 0.9) for h in (6, 12, 24)], "entity int, hours int, a10 double, a90 double, b10 double, b90 double")
    got = sandbox.counterfactuals(bands, spark.createDataFrame([(1, 0.05)], "entity int, base double")).collect()
    assert len(got) == 3 and all(r.delta <= 0 for r in got)


def test_ids_and_formats(spark):
    import uuid

    from tideline.functions import ids

    df = spark.createDataFrame([("abc", 1234567.4, 0.256), (None, 1.0, 0.5)], "s string, m double, p double")
    r = df.select(ids.uuid5("s").alias("u"), ids.hash_embedding(F.col("s"), 40).alias("e"), ids.money(F.col("m")).alias("m"), ids.percent(F.col("p")).alias("p")).collect()
    assert r[0].u == str(uuid.uuid5(uuid.NAMESPACE_DNS, "abc")) and r[1].u is None and (r[0].m, r[0].p) == ("$1,234,567", "25.6%")
    assert len(r[0].e) == 40 and abs(sum(x * x for x in r[0].e) - 1) < 1e-12


def prices(spark, rows):
    return spark.createDataFrame(rows, "instrument int, event_id long, m int, price double").withColumn("ts", F.timestamp_seconds(F.col("m") * 3600))


@pytest.mark.parametrize("size", [4, 7, 16_384])
def test_changepoints_in_chunks_equal_the_one_pass_update(spark, size):
    import random

    from tideline.operators import signals

    r = random.Random(3)
    rows = [(i % 2, i, i * 7 % 90, r.choice([0.0, -1.0, *(r.uniform(1, 400) for _ in range(6))])) for i in range(90)]
    want, state = {}, {}
    for k, i, m, price in sorted(rows, key=lambda x: (x[2], x[1])):
        s = state.setdefault(k, {"prev": None, "n": 0, "mean": 0.0, "m2": 0.0, "last": None, "rets": []})
        ret = None
        if s["prev"] is not None:
            ret = math.log(price / s["prev"]) if s["prev"] > 0 and price > 0 else 0.0
            s["n"] += 1
            d = ret - s["mean"]
            s["mean"] += d / s["n"]
            s["m2"] += d * (ret - s["mean"])
        s["rets"].append(ret if s["prev"] and s["prev"] > 0 and price > 0 else None)
        s["prev"] = price
        z = abs(ret - s["mean"]) / math.sqrt(max(s["m2"] / (s["n"] - 1), 1e-12)) if s["n"] >= 5 else None
        prob = min(1.0, 0.01 * (1 + z * z / 2)) if z is not None else 0.0
        flag = prob > 0.6 or (z or 0) > 3.5
        since = (price / s["last"] - 1) * 100 if flag and s["last"] else None
        if flag:
            s["last"] = price
        real = [x for x in s["rets"][-19:] if x is not None]
        premium = round(min(1.0, max(0.0, math.sqrt(sum(x * x for x in real) / len(real)) / 0.01 - 1)), 4) if s["n"] >= 9 and real else 0.0
        want[i] = (ret, prob, flag, since, premium)
    df = prices(spark, rows)
    got = {x.event_id: (x.ret, x.prob, x.flag, x.pct_since) for x in signals.since_flagged(signals.changepoints(df, size=size)).collect()}
    premium = {x.event_id: x.premium for x in signals.war_premium(df, size=max(size, 20)).collect()}
    assert len(got) == len(premium) == 90
    for i, (ret, prob, flag, since, prem) in want.items():
        for a, b in zip(got[i], (ret, prob, flag, since)):
            assert a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
        assert abs(premium[i] - prem) < 2e-4


def test_frames_in_chunks(spark):
    from pyspark.sql import Window

    from tideline.operators import signals

    df = prices(spark, [(i % 2, i, i * 7 % 90, float(i * i % 37)) for i in range(90)])
    w = Window.partitionBy("instrument").orderBy("ts", "event_id")
    for last in (5, None):
        frame = w.rowsBetween(Window.unboundedPreceding if last is None else -last, -1)
        both = signals.tone_delta(df, "instrument", "ts", "event_id", "price", last, size=11).select("event_id", "delta").join(df.withColumn("want", F.col("price") - F.coalesce(F.avg("price").over(frame), F.col("price"))), "event_id")
        assert both.count() == 90 and both.where("abs(delta - want) > 1e-6").count() == 0
    got = signals.premium_on_base(df, 36.0, rows=5, size=11).select("event_id", "base", "ever").join(df.withColumns({"want": F.avg("price").over(w.rowsBetween(-5, -1)), "alarm": F.max(F.col("price") >= 36.0).over(w)}), "event_id")
    assert got.count() == 90 and got.where("not (base <=> want) or ever <> alarm").count() == 0


@pytest.mark.parametrize("parts", [2, 3, 64])
def test_roc_in_parts(spark, parts):
    import random

    from tideline.operators import ledger

    r = random.Random(4)
    rows = [(int(r.random() < x / 40), float(x)) for x in (r.randrange(40) for _ in range(400))]
    pos, neg = [x for y, x in rows if y], [x for y, x in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    j = {t: sum(p >= t for p in pos) / len(pos) - sum(n >= t for n in neg) / len(neg) for t in {x for _, x in rows}}
    got = one(ledger.roc(spark.createDataFrame(rows, "y int, x double"), parts=parts))
    assert math.isclose(got.auc, auc, abs_tol=1e-8) and math.isclose(got.j, max(j.values()), abs_tol=1e-8) and math.isclose(j[got.threshold], max(j.values()), abs_tol=1e-8)


SENTIMENTS = [
    ("Iran threatens closure of the strait", "Highly Risky"), ("A MISSILE was seen", "Highly Risky"), ("forward plans", "Highly Risky"), ("New sanction on tankers after the deal", "Risky"),
    ("Premium rises", "Risky"), ("Ceasefire holds", "Safe"), ("markets stabilise", "Safe"), ("Nothing of note", "Satisfactory"), ("", "Satisfactory"), (None, "Satisfactory"),
]
ACTS = [
    ("IRGC seizes tanker off Iran. India waits", "Iran", "vessel_seizure"), ("Saudi Arabia to cut output", "Saudi Arabia", "production_cut"), ("Exports to China rise", "China", "export_change"),
    ("Talks negotiate a treaty", "unknown", "diplomacy"), ("Quiet day. Iran attack", "unknown", "general"), ("drone strike on refinery", "unknown", "refinery_event"), ("Industry news", "US", "general"), (None, "unknown", "general"),
]
SPOKEN = [
    ("Run the Hormuz disruption scenario", ("run_scenario", "Strait of Hormuz", "Running the Strait of Hormuz scenario.", False)),
    ("run a scenario", (None, None, None, True)),
    ("tell me more about hormuz", ("open_wiki", "Strait of Hormuz", None, True)),
    ("Show me the strait of hormuz", ("focus_entity", "Strait of Hormuz", "Here's Strait of Hormuz.", False)),
    ("what is the SPR coverage", ("flash_kpi", "spr_coverage_pct", None, False)),
    ("what is the risk level at jamnagar", ("open_wiki", "Jamnagar", None, True)),
    ("go to the map", ("navigate", "/intelligence", "Global Intelligence.", False)),
    ("open the reserve planner", ("flash_kpi", "spr_coverage_pct", None, False)),
    ("pick option 2", ("select_option", "2", "Selecting 2.", False)),
    ("never mind", (None, None, None, False)),
    ("why did it rise", (None, None, None, True)),
    ("a b c d", (None, None, None, False)),
    ("a b c d e", (None, None, None, True)),
    ("  ", (None, None, None, False)),
    (None, (None, None, None, False)),
]
ROUTES = [("Why now?", "graph"), ("show the list", "vector"), ("somehow it rose", "vector"), ("trade-off of both", "graph"), ("TRADEOFF", "graph"), (" ".join("abcdefghijkl"), "vector"), (" ".join("abcdefghijklm"), "graph"), ("what would happen then", "graph")]


def test_text_rules(spark):
    from tideline.functions import text as T

    c = F.col("t")
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(SENTIMENTS)], "i int, t string").select("i", T.sentiment(c).alias("v")).orderBy("i")
    assert [r.v for r in rows.collect()] == [w for _, w in SENTIMENTS]
    s = T.before_stop(c)
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(ACTS)], "i int, t string").select("i", T.actor(s).alias("a"), T.action(s).alias("b")).orderBy("i")
    assert [(r.a, r.b) for r in rows.collect()] == [(a, b) for _, a, b in ACTS]
    names = {"Strait of Hormuz": "Strait of Hormuz", "Hormuz": "Strait of Hormuz", "Jamnagar": "Jamnagar"}
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPOKEN)], "i int, t string").select("i", T.command(c, T.spoken_entity(c, names)).alias("v")).orderBy("i")
    assert [tuple(r.v) for r in rows.collect()] == [w for _, w in SPOKEN]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ROUTES)], "i int, t string").select("i", T.route(c).alias("v")).orderBy("i")
    assert [r.v for r in rows.collect()] == [w for _, w in ROUTES]


def test_boosted_trees_and_attributions(spark):
    import random

    from tideline.operators import models

    r = random.Random(2)
    rows = spark.createDataFrame([(i, i % 3, x := r.random(), r.random(), int(x > 0.5)) for i in range(150)], "id int, g int, a double, b double, y int")
    out = models.leave_one_out(rows, ["a", "b"], "y", "g", trees=3, folds=2)
    assert out.count() == 150 and out.where("(probability_ > 0.5) <> (y = 1)").count() < 15
    model, platt = models.classifier(rows, ["a", "b"], "y", trees=3, folds=2)
    got = models.attributions(rows.select("id", "a", "b"), "id", {"fa": ["a"], "fb": ["b"]}, {"a": 0.1, "b": 0.5}, lambda d: models.probabilities(d, model, platt)).collect()
    assert len(got) == 150 and all(abs(x.fa + x.fb - (x.score - x.base)) < 1e-9 for x in got) and sum(abs(x.fa) for x in got) > 5 * sum(abs(x.fb) for x in got)


def test_best_match_against_brute_force(spark):
    import numpy as np

    from tideline.operators.vectors import best_match

    v = np.random.default_rng(1).standard_normal((90, 6))
    v[7] = 0
    v[8] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    n = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    s = n @ n.T
    np.fill_diagonal(s, -9)
    for block in (1000, 8):
        got = {x.id: x.similarity for x in best_match(df.where("id % 3 = 0 or id = 7"), df, "id", "v", block).collect()}
        assert set(got) == {i for i in range(90) if i % 3 == 0 or i == 7} and all(math.isclose(x, s[i].max(), abs_tol=1e-12) for i, x in got.items())


def test_prose_has_every_kind(spark):
    from tideline.functions.prose import SENTENCES, prose

    df = spark.createDataFrame([("Alpha", "Iraq", "2.5", "True")], "canonical_name string, country string, daily_export_mbpd string, sanctioned string")
    assert df.select(prose("Supplier")).first()[0] == "Alpha (Supplier) is based in country Iraq, has daily_export_mbpd of 2.5, and is sanctioned."
    df = spark.createDataFrame([("Spill", None)], "canonical_name string, actor string").selectExpr("*", "'x' as action", "cast(null as string) severity", "'2024' event_time")
    assert df.select(prose("GeoEvent")).first()[0] == "Spill (GeoEvent): actor , action x, severity , event_time 2024."
    assert len(SENTENCES) == 17
