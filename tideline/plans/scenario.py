"""What-if queries: cascades, agents, sector effects, reserve plans, projections."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import HORIZONS_H, REVERSION, SCENARIO, SDP_ACTIONS, SDP_DISCOUNT, SDP_LEVELS, Z90
from ..operators import reserve, scenario
from ..sources.views import table, with_
from .registry import query
from .risk import CUR_SQL, current_scores

#: Scenarios of the catalogue: one for each rule of the cascade.
PRESETS = [
    {"scenario": "strait_full", "fraction": 1.0, "consumption": 5.25, "import_pct": 88.6, "spr_fill": 0.572},
    {"scenario": "strait_half", "fraction": 0.4, "consumption": 5.25, "import_pct": 88.6, "spr_fill": 0.572},
    {"scenario": "strait_and_bypass", "fraction": 0.7, "bypass_blocked": 0.9, "consumption": 5.25, "spr_fill": 0.3},
    {"scenario": "slow_rise", "profile": "escalating", "bypass_blocked": 0.9},
    {"scenario": "slow_end", "profile": "resolving", "bypass_blocked": 0.9, "policy": "aggressive"},
    {"scenario": "no_draw", "policy": "none", "bypass_blocked": 1.0, "days": 40, "inventory_days": 7.0},
    {"scenario": "less_demand", "demand_cut": 0.12, "spr_floor_days": 1.5, "days": 20},
    {"scenario": "producers_cut", "supply_cut": 0.8, "days": 45, "spr_fill": 0.45},
    {"scenario": "nothing", "fraction": 0.0},
]


def _literal(v) -> str:
    return f"'{v}'" if isinstance(v, str) else f"{float(v)!r}::DOUBLE" if isinstance(v, float) else str(v)


def _values(rows: list[dict]) -> str:
    cols = ["scenario", *SCENARIO]
    full = [SCENARIO | r for r in rows]
    return f"p({', '.join(cols)}) AS (VALUES " + ",\n".join("(" + ", ".join(_literal(type(SCENARIO[c])(r[c]) if c in SCENARIO else r[c]) for c in cols) + ")" for r in full) + ")"


#: A day-by-day loop, which says the cascade another way than the windows do.
CASCADE_SQL = """
d AS (SELECT *, consumption * (1 - demand_cut) AS used, spr_total * spr_fill * 7.33::DOUBLE AS start, CASE policy WHEN 'aggressive' THEN 1.5::DOUBLE WHEN 'none' THEN 0::DOUBLE ELSE 1::DOUBLE END AS pol FROM p),
k AS (SELECT d.*, spr_floor_days * used AS floor_ FROM d),
day_ AS (SELECT k.*, t AS day,
  CASE WHEN t >= days THEN 0::DOUBLE WHEN profile = 'escalating' THEN least(1, (t + 1) / greatest(days * 0.5::DOUBLE, 1)) WHEN profile = 'resolving' THEN greatest(0, 1 - t / greatest(days, 1)) ELSE 1::DOUBLE END AS sev
  FROM k, range(0, 45) r(t) WHERE t < horizon),
n AS (SELECT *, used * share_pct / 100 * sev * fraction AS lost, greatest(0, least(1, (day - ramp_days) / greatest(ramp_days, 1))) AS ramp FROM day_),
net AS (SELECT *, CASE WHEN supply_cut > 0 THEN greatest(0, supply_cut * sev * fraction) ELSE greatest(0, lost - least(bypass * (1 - bypass_blocked), lost) * ramp) END AS net FROM n),
loop_ AS (
  SELECT scenario, day, net, least(spr_draw * pol, net, greatest(0, start - floor_)) AS draw, start - least(spr_draw * pol, net, greatest(0, start - floor_)) AS left_, net - least(spr_draw * pol, net, greatest(0, start - floor_)) AS cum FROM net WHERE day = 0
  UNION ALL
  SELECT x.scenario, x.day, x.net, least(x.spr_draw * x.pol, x.net, greatest(0, l.left_ - x.floor_)), l.left_ - least(x.spr_draw * x.pol, x.net, greatest(0, l.left_ - x.floor_)), l.cum + greatest(0, x.net - least(x.spr_draw * x.pol, x.net, greatest(0, l.left_ - x.floor_)))
  FROM loop_ l JOIN net x ON x.scenario = l.scenario AND x.day = l.day + 1)"""


def presets(spark):
    return scenario.scenarios(spark, PRESETS)


_HEAD = "WITH RECURSIVE " + _values(PRESETS) + "," + CASCADE_SQL


@query("io_cascade", _HEAD + " SELECT scenario, CAST(day AS INTEGER) AS day, round(net, 6) AS net, round(draw, 6) AS draw, round(left_, 6) AS reserve FROM loop_")
def io_cascade(spark, sf_dir):
    d = scenario.daily(presets(spark))
    before = F.coalesce(F.lag("left").over(Window.partitionBy("scenario").orderBy("day")), F.col("spr_total") * F.col("spr_fill") * 7.33)
    return d.select("scenario", "day", F.round("net", 6).alias("net"), (F.round(before - F.col("left"), 6) + 0.0).alias("draw"), F.round("left", 6).alias("reserve"))


_SUMMARY = """,
s AS (SELECT l.scenario, max(round(l.net, 4)) AS gap, count(*) FILTER (round(l.net, 4) > 0.01) AS gap_days, round(sum(round(l.net, 4)), 4) AS total,
  coalesce(min(l.day) FILTER (l.left_ <= k.floor_ + 1e-9 AND l.net > 0), any_value(k.horizon))::DOUBLE AS spr_day,
  coalesce(min(l.day) FILTER (l.cum >= k.inventory_days * k.used AND l.net > l.draw), any_value(k.horizon))::DOUBLE AS product_day FROM loop_ l JOIN k USING (scenario) GROUP BY l.scenario),
g AS (SELECT s.*, k.price_low, k.price_high, k.gdp_per_usd, k.cpi_per_usd, greatest(0, CASE WHEN supply_cut > 0 THEN supply_cut / greatest(consumption * import_pct / 100 / 100, 0.01::DOUBLE) * fraction - spare ELSE 20 * fraction - spare - global_bypass END) AS shock FROM s JOIN k USING (scenario)),
h AS (SELECT *, round(price_low * shock, 2) AS price_lo, round(price_high * shock, 2) AS price_hi FROM g)
"""


@query("io_cascade_presets", _HEAD + _SUMMARY + "SELECT scenario, gap, gap_days, total, spr_day, price_lo, price_hi, round((price_lo + price_hi) / 2 * gdp_per_usd, 3) AS gdp_pct, round((price_lo + price_hi) / 2 * cpi_per_usd, 3) AS cpi_pct FROM h")
def io_cascade_presets(spark, sf_dir):
    return scenario.summary(presets(spark)).select("scenario", "gap", "gap_days", "total", "spr_day", "price_lo", "price_hi", "gdp_pct", "cpi_pct")


@query("product_shortfall", _HEAD + _SUMMARY + "SELECT scenario, product_day, row_number() OVER (ORDER BY gap DESC, scenario) AS rank FROM h")
def product_shortfall(spark, sf_dir):
    s = scenario.summary(presets(spark))
    return s.select("scenario", "product_day", F.row_number().over(Window.orderBy(F.desc("gap"), "scenario")).cast("long").alias("rank"))


@query("production_cut", _HEAD + _SUMMARY + "SELECT scenario, round(shock, 6) AS shock, price_lo, price_hi FROM h WHERE scenario = 'producers_cut'")
def production_cut(spark, sf_dir):
    return scenario.summary(presets(spark)).where("scenario = 'producers_cut'").select("scenario", F.round("shock", 6).alias("shock"), "price_lo", "price_hi")


_PLANTS = "plant AS (SELECT n_name AS plant, n_nationkey / 20.0::DOUBLE + 0.1::DOUBLE AS capacity, (n_nationkey % 10) / 10.0::DOUBLE AS exposure, (5 + n_nationkey % 7) * (n_nationkey / 20.0::DOUBLE + 0.1::DOUBLE) * 0.1::DOUBLE AS stock FROM nation)"


def plants(spark, sf_dir):
    k = F.col("n_nationkey")
    capacity = k / 20.0 + 0.1
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("plant"), capacity.alias("capacity"), (k % 10 / 10.0).alias("exposure"), ((5 + k % 7) * capacity * 0.1).alias("stock"))


@query("node_impacts", _HEAD + "," + _PLANTS + """,
w AS (SELECT plant, capacity * exposure / sum(capacity * exposure) OVER () AS part FROM plant),
g AS (SELECT l.scenario, plant, day, round(round(net, 4) * part, 6) AS g FROM loop_ l, w)
SELECT scenario, plant, max(g) AS peak, coalesce(min(day) FILTER (g > 0.001), 45)::DOUBLE AS onset FROM g GROUP BY ALL""")  # fmt: skip
def node_impacts(spark, sf_dir):
    return scenario.node_impacts(presets(spark), plants(spark, sf_dir))


@query("sector_impacts", _HEAD + _SUMMARY + ", sec(sector, share) AS (VALUES ('transport', 41.0::DOUBLE), ('industry', 24.5::DOUBLE), ('power', 7.5::DOUBLE), ('agriculture', 13.0::DOUBLE)) SELECT scenario, sector, round(gap * share / 100, 6) AS shortfall FROM h, sec")
def sector_impacts(spark, sf_dir):
    sectors = spark.createDataFrame([("transport", 41.0), ("industry", 24.5), ("power", 7.5), ("agriculture", 13.0)], "sector string, share double")
    return scenario.summary(presets(spark)).crossJoin(F.broadcast(sectors)).select("scenario", "sector", F.round(F.col("gap") * F.col("share") / 100, 6).alias("shortfall"))


_VARIED = [{"scenario": f"{name}{sign}", name: SCENARIO[name] * (1.2 if sign == "+" else 0.8)} for name in ("bypass", "share_pct", "consumption", "ramp_days", "spr_fill") for sign in "+-"]


@query("sensitivity", "WITH RECURSIVE " + _values(_VARIED) + "," + CASCADE_SQL + """,
s AS (SELECT scenario, sum(net) AS total FROM loop_ GROUP BY scenario)
SELECT substr(a.scenario, 1, length(a.scenario) - 1) AS param, round(a.total, 6) AS high, round(b.total, 6) AS low, round(a.total - b.total, 6) AS swing
FROM s a JOIN s b ON substr(a.scenario, 1, length(a.scenario) - 1) = substr(b.scenario, 1, length(b.scenario) - 1) WHERE right(a.scenario, 1) = '+' AND right(b.scenario, 1) = '-' ORDER BY abs(swing) DESC, param""")  # fmt: skip
def sensitivity(spark, sf_dir):
    """Each parameter 20 % up and down: the total gap, the widest swing first."""
    t = scenario.daily(scenario.scenarios(spark, _VARIED)).groupBy(F.expr("left(scenario, length(scenario) - 1)").alias("param")).agg(F.sum(F.when(F.col("scenario").endswith("+"), F.col("net"))).alias("high"), F.sum(F.when(F.col("scenario").endswith("-"), F.col("net"))).alias("low"))
    return t.select("param", F.round("high", 6).alias("high"), F.round("low", 6).alias("low"), F.round(F.col("high") - F.col("low"), 6).alias("swing")).orderBy(F.desc(F.abs("swing")), "param")


@query("mitigation", _HEAD + _SUMMARY + "SELECT scenario, round(least(0.4::DOUBLE * gap, 0.6::DOUBLE * 0.75::DOUBLE * gap) + 0.1::DOUBLE, 6) AS offset_, round(greatest(0, gap - least(0.4::DOUBLE * gap, 0.6::DOUBLE * 0.75::DOUBLE * gap) - 0.1::DOUBLE), 6) AS residual FROM h")
def mitigation(spark, sf_dir):
    g = F.col("gap")
    relief = F.least(0.4 * g, F.lit(0.6) * 0.75 * g) + 0.1
    return scenario.summary(presets(spark)).select("scenario", F.round(relief, 6).alias("offset_"), F.round(F.greatest(F.lit(0.0), g - F.least(0.4 * g, F.lit(0.6) * 0.75 * g) - 0.1), 6).alias("residual"))


@query("ui_projection", _HEAD + _SUMMARY + ", f AS (SELECT scenario, min(day) FILTER (net = m) AS peak_day FROM (SELECT *, max(net) OVER (PARTITION BY scenario) AS m FROM loop_) GROUP BY scenario) SELECT scenario, CAST(peak_day AS INTEGER) AS peak_day, round(least(1, greatest(0.1::DOUBLE, gap / 2.19::DOUBLE)), 6) AS fraction FROM h JOIN f USING (scenario)")
def ui_projection(spark, sf_dir):
    d = scenario.daily(presets(spark)).groupBy("scenario").agg(F.min_by("day", F.struct(-F.col("net"), "day")).alias("peak_day"))
    return scenario.summary(presets(spark)).join(d, "scenario").select("scenario", "peak_day", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("gap") / 2.19)), 6).alias("fraction"))


@query("abm", "WITH RECURSIVE " + _PLANTS + """,
l AS (SELECT plant, stock, t AS day, CASE WHEN t < 30 THEN capacity * exposure ELSE 0::DOUBLE END AS loss FROM plant, range(0, 45) r(t)),
lp AS (SELECT plant, day, greatest(0, loss - stock) AS need, greatest(0, stock - loss) AS stock FROM l WHERE day = 0
  UNION ALL SELECT l.plant, l.day, greatest(0, l.loss - lp.stock), greatest(0, lp.stock - l.loss) FROM lp JOIN l ON l.plant = lp.plant AND l.day = lp.day + 1),
c AS (SELECT *, sum(need) OVER (PARTITION BY day) AS total, 4 * greatest(0, least(1, (day - 5) / 5)) AS pool FROM lp),
g AS (SELECT *, greatest(0, need - CASE WHEN total > 0 AND pool > 0 THEN need / total * least(pool, total) ELSE 0 END) AS gap FROM c),
d AS (SELECT day, sum(gap) AS gap, least(1, any_value(total) / 4) AS used FROM g GROUP BY day)
SELECT round(max(gap), 6) AS peak_gap, round(sum(gap), 6) AS total_gap, (SELECT count(DISTINCT plant) FROM g WHERE gap > 0.001) AS rationing, round(avg(used), 6) AS utilization, coalesce(max(day) FILTER (gap >= 0.01) + 1, 1) AS stable_day FROM d""")  # fmt: skip
def abm(spark, sf_dir):
    a = scenario.agents(plants(spark, sf_dir))
    d = a.groupBy("day").agg(F.sum("gap").alias("gap"), F.least(F.lit(1.0), F.first("total") / 4).alias("used"))
    r = a.where("gap > 0.001").agg(F.countDistinct("plant").alias("rationing"))
    return d.agg(F.round(F.max("gap"), 6).alias("peak_gap"), F.round(F.sum("gap"), 6).alias("total_gap"), F.round(F.avg("used"), 6).alias("utilization"), F.coalesce(F.max(F.when(F.col("gap") >= 0.01, F.col("day"))) + 1, F.lit(1)).cast("long").alias("stable_day")).crossJoin(F.broadcast(r))


#: An invented economy of four sectors.
SECTORS = ["farming", "refining", "industry", "services"]
MATRIX = [[0.10, 0.02, 0.15, 0.03], [0.08, 0.20, 0.12, 0.06], [0.12, 0.10, 0.25, 0.09], [0.05, 0.11, 0.14, 0.18]]
PETROLEUM = [0.12, 0.55, 0.18, 0.07]
_A = "a(i, j, x) AS (VALUES " + ", ".join(f"({i}, {j}, {x}::DOUBLE)" for i, r in enumerate(MATRIX) for j, x in enumerate(r)) + ")"
_N = len(SECTORS)


@query("leontief", f"WITH RECURSIVE {_A}, s(i, sector, pet) AS (VALUES " + ", ".join(f"({i}, '{s}', {p}::DOUBLE)" for i, (s, p) in enumerate(zip(SECTORS, PETROLEUM))) + f"""),
m AS (SELECT list(x ORDER BY i, j) AS a FROM a),
pw AS (SELECT 0 AS n, (SELECT list(CASE WHEN i = j THEN 1::DOUBLE ELSE 0::DOUBLE END ORDER BY i, j) FROM a) AS p
  UNION ALL SELECT n + 1, list_transform(range(0, {_N * _N}), lambda q: list_sum(list_transform(range(0, {_N}), lambda r: p[(q // {_N}) * {_N} + r + 1] * m.a[r * {_N} + q % {_N} + 1]))) FROM pw, m WHERE n < 40),
inv AS (SELECT q // {_N} AS i, q % {_N} AS j, sum(v) AS x FROM (SELECT unnest(range(0, {_N * _N})) AS q, unnest(p) AS v FROM pw) GROUP BY ALL)
SELECT s.sector, round((SELECT sum(x) FROM inv WHERE j = s.i), 6) AS multiplier, round((SELECT sum(x * t.pet) FROM inv JOIN s t ON t.i = inv.j WHERE inv.i = s.i), 6) AS quantity, round((SELECT sum(x * t.pet) FROM inv JOIN s t ON t.i = inv.i WHERE inv.j = s.i), 6) AS price FROM s""")  # fmt: skip
def leontief(spark, sf_dir):
    return scenario.leontief(spark, SECTORS, MATRIX, PETROLEUM).select("sector", *[F.round(c, 6).alias(c) for c in ("multiplier", "quantity", "price")])


_OPTIONS = [("likely", 0.55, 5.0, 0.12, 1.0, 80.0), ("unsure", 0.20, 5.0, 0.12, 1.0, 80.0), ("unlikely", 0.05, 5.0, 0.12, 1.0, 80.0), ("no_gap", 0.5, 5.0, 0.12, 0.0, 80.0), ("small", 0.35, 8.0, 0.2, 0.37, 95.0)]


@query("option_value", "WITH o(name, p, days, premium, gap, price) AS (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE, {f}::DOUBLE)" for a, b, c, d, e, f in _OPTIONS) + """),
v AS (SELECT *, price * gap * days AS now FROM o), x AS (SELECT name, CASE WHEN gap <= 0 OR days <= 0 THEN 0 ELSE round(now - (p * now * 0.3::DOUBLE + (1 - p) * (now * 0.3::DOUBLE + now + now * premium)), 2) END AS value FROM v)
SELECT name, value, CASE WHEN value > 0 THEN 'WAIT' ELSE 'DRAW NOW' END AS advice FROM x""")  # fmt: skip
def option_value(spark, sf_dir):
    c = F.col
    o = spark.createDataFrame(_OPTIONS, "name string, p double, days double, premium double, gap double, price double")
    v = reserve.option_value(c("p"), c("days"), c("premium"), c("gap"), c("price"))
    return o.select("name", v.alias("value")).withColumn("advice", F.when(c("value") > 0, "WAIT").otherwise("DRAW NOW"))


_PLANS = [("base", 2.13, 0.56, 0.109, 80.0, 5.0, 30, 90, 2.0, 0.6), ("tight", 1.2, 0.56, 0.2, 95.0, 40.0, 45, 60, 3.0, 0.6), ("easy", 4.0, 0.4, 0.02, 80.0, 0.0, 10, 45, 2.0, 0.6)]
_PLAN_SCHEMA = "scenario string, s0 double, cons double, gap_mmt double, price double, lam double, gap_days int, horizon int, buffer_days double, draw_fraction double"


def _sdp_sql() -> str:
    rows = ", ".join("(" + ", ".join(_literal(x) for x in r) + ")" for r in _PLANS)
    cols = ", ".join(x.split()[0] for x in _PLAN_SCHEMA.split(", "))
    n = SDP_LEVELS - 1

    def total(a: float) -> str:
        draw = f"(q.maxdraw * {a}::DOUBLE)"
        res = f"greatest(0, l * q.rmax / {n} - {draw})"
        nxt = f"CAST(least({n}, greatest(0, ceil(least({res}, q.rmax) / (q.rmax / {n}) - 1e-9))) AS BIGINT)"
        return f"CASE WHEN {draw} > l * q.rmax / {n} + 1e-9 THEN -1e18 ELSE -(greatest(0, CASE WHEN f.t - 1 < q.gap_days THEN q.gap_mmt ELSE 0 END - {draw}) * q.price / 1.09e-7::DOUBLE * 0.000001::DOUBLE) - CASE WHEN {res} < q.buf THEN q.lam ELSE 0 END + {SDP_DISCOUNT}::DOUBLE * f.v[{nxt} + 1] END"

    best = "greatest(" + ", ".join(total(a) for a in SDP_ACTIONS) + ")"
    return f"""WITH RECURSIVE p({cols}) AS (VALUES {rows}),
q AS (SELECT *, buffer_days * cons AS buf, greatest(s0 * 1.5, buffer_days * cons * 2.5) AS rmax, least(gap_mmt, cons * draw_fraction) AS maxdraw FROM p),
f AS (SELECT scenario, horizon AS t, list_transform(range(0, {SDP_LEVELS}), lambda i: 0::DOUBLE) AS v FROM q
  UNION ALL SELECT f.scenario, f.t - 1, (SELECT list(b ORDER BY l) FROM (SELECT l, {best} AS b FROM range(0, {SDP_LEVELS}) g(l))) FROM f JOIN q ON q.scenario = f.scenario WHERE f.t > 0)
SELECT scenario, CAST(unnest(range(0, {SDP_LEVELS})) AS INTEGER) AS level, round(unnest(v), 6) AS value FROM f WHERE t = 0"""


@query("sdp_values", _sdp_sql())
def sdp_values(spark, sf_dir):
    v = reserve.value_function(spark.createDataFrame(_PLANS, _PLAN_SCHEMA))
    return v.select("scenario", F.posexplode("v0").alias("level", "value")).withColumn("value", F.round("value", 6))


def _plan_sql(select: str) -> str:
    n = SDP_LEVELS - 1
    level = f"least({n}, greatest(0, ceil(least(w.r, q.rmax) / (q.rmax / {n}) - 1e-9))) * q.rmax / {n}"

    def total(a: float) -> str:
        draw, res = f"(x.maxdraw * {a}::DOUBLE)", f"greatest(0, x.l - x.maxdraw * {a}::DOUBLE)"
        nxt = f"CAST(least({n}, greatest(0, ceil(least({res}, x.rmax) / (x.rmax / {n}) - 1e-9))) AS BIGINT)"
        return f"CASE WHEN {draw} > x.l + 1e-9 THEN -1e18 ELSE -(greatest(0, x.need - {draw}) * x.price / 1.09e-7::DOUBLE * 0.000001::DOUBLE) - CASE WHEN {res} < x.buf THEN x.lam ELSE 0 END + {SDP_DISCOUNT}::DOUBLE * x.v[{nxt} + 1] END"

    head = _sdp_sql().rsplit("SELECT scenario, CAST(unnest", 1)[0].rstrip()
    return f"""{head},
walk AS (SELECT scenario, 0 AS t, s0 AS r, 0::DOUBLE AS d, 0::DOUBLE AS unmet FROM q
  UNION ALL SELECT scenario, t + 1, greatest(0, r - d2), d2, greatest(0, need - d2) FROM (
    SELECT scenario, t, r, need, least(maxdraw * ({SDP_ACTIONS})[list_position(c, list_max(c))], r) AS d2 FROM (
      SELECT x.*, [{", ".join(total(a) for a in SDP_ACTIONS)}] AS c FROM (
        SELECT w.scenario, w.t, w.r, q.maxdraw, q.rmax, q.buf, q.lam, q.price, CASE WHEN w.t < q.gap_days THEN q.gap_mmt ELSE 0 END AS need, {level} AS l, f.v
        FROM walk w JOIN q ON q.scenario = w.scenario JOIN f ON f.scenario = w.scenario AND f.t = w.t + 1) x))),
days AS (SELECT walk.*, q.buf FROM walk JOIN q USING (scenario) WHERE t > 0)
{select}"""


@query("sdp_plan", _plan_sql("SELECT scenario, CAST(t AS INTEGER) AS day, round(d, 6) AS volume, round(r, 6) AS reserve, round(unmet, 6) AS unmet, CASE WHEN d > 1e-6 THEN 'drawing' WHEN r < buf * 1.3::DOUBLE THEN 'near floor' ELSE 'holding' END AS driver FROM days"))
def sdp_plan(spark, sf_dir):
    d = reserve.plan(spark.createDataFrame(_PLANS, _PLAN_SCHEMA))
    near = F.when((F.col("volume") > 1e-6) & (F.col("unmet") >= 0), "drawing").when(F.col("reserve") < F.col("buf") * 1.3, "near floor").otherwise("holding")
    return d.select("scenario", "day", F.round("volume", 6).alias("volume"), F.round("reserve", 6).alias("reserve"), F.round("unmet", 6).alias("unmet"), near.alias("driver"))


@query("sdp_summary", _plan_sql("SELECT scenario, round(sum(d), 6) AS drawn, count(*) FILTER (d > 1e-6) AS draw_days, round(max(unmet), 6) AS peak_unmet, round(1 - count(*) FILTER (r < buf) / count(*), 6) AS prob FROM days GROUP BY scenario"))
def sdp_summary(spark, sf_dir):
    s = reserve.plan_summary(reserve.plan(spark.createDataFrame(_PLANS, _PLAN_SCHEMA)))
    return s.select("scenario", *[F.round(c, 6).alias(c) for c in ("drawn", "peak_unmet", "prob")], "draw_days")


@query("spr_curve", "SELECT CAST(t AS INTEGER) AS day, round(greatest(0, 3.05::DOUBLE - 0.68::DOUBLE * t), 6) AS fill FROM range(0, 31) r(t)")
def spr_curve(spark, sf_dir):
    return spark.range(31).select(F.col("id").cast("int").alias("day"), F.round(F.greatest(F.lit(0.0), 3.05 - 0.68 * F.col("id")), 6).alias("fill"))


@query("trajectory", with_("sig") + f""",
h AS (SELECT entity, date_trunc('day', ts) AS d, avg(anomaly) * 5 AS x FROM sig WHERE source = 'ais' GROUP BY ALL),
s AS (SELECT entity, list(x ORDER BY d) AS xs FROM h GROUP BY entity),
l AS (SELECT entity, xs[-1] AS level0, list_transform(range(1, len(xs)), lambda i: xs[i + 1] - xs[i]) AS ds FROM s),
v AS (SELECT entity, level0, list_avg(ds[-3:]) AS drift, greatest(list_stddev_pop(ds), 0.5::DOUBLE) AS vol FROM l),
m AS (SELECT entity, hh, vol, greatest(0, least(10, level0 + drift * (1 - pow({REVERSION}::DOUBLE, hh / 6)) / (1 - {REVERSION}::DOUBLE))) AS m FROM v, (SELECT unnest({HORIZONS_H}) AS hh))
SELECT entity, CAST(hh AS INTEGER) AS hours, round(m, 6) AS median, round(greatest(0, least(10, m - {Z90}::DOUBLE * vol * sqrt(hh / 6))), 6) AS p10, round(greatest(0, least(10, m + {Z90}::DOUBLE * vol * sqrt(hh / 6))), 6) AS p90 FROM m""")  # fmt: skip
def trajectory(spark, sf_dir):
    from ..operators.sandbox import project
    from ..sources.views import signals

    daily = signals(spark, sf_dir).where("source = 'ais'").groupBy("entity", F.date_trunc("day", "ts").alias("d")).agg((F.avg("anomaly") * 5).alias("x"))
    series = daily.groupBy("entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("xs"))
    return project(series, "xs", 10.0).select("entity", "hours", *[F.round(c, 6).alias(c) for c in ("median", "p10", "p90")])


def _bands(spark, sf_dir):
    """(entity, hours, bands of both series, medians) and each entity's constant part of the score."""
    from ..operators.sandbox import project
    from ..sources.views import signals

    daily = signals(spark, sf_dir).where("source = 'ais'").groupBy("entity", F.date_trunc("day", "ts").alias("d")).agg((F.avg("anomaly") * 5).alias("x"), (F.avg("k") / 100).alias("y"))
    series = daily.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("d", "x", "y"))).alias("s")).select("entity", F.transform("s", lambda s: s["x"]).alias("xs"), F.transform("s", lambda s: s["y"]).alias("ys"))
    a = project(series, "xs", 10.0).select("entity", "hours", F.col("median").alias("a50"), F.col("p10").alias("a10"), F.col("p90").alias("a90"))
    p = project(series, "ys", 1.0).select("entity", "hours", F.col("median").alias("b50"), F.col("p10").alias("b10"), F.col("p90").alias("b90"))
    return a.join(p, ["entity", "hours"]), current_scores(spark, sf_dir).select("entity", (0.25 * F.col("factor_gdelt") + 0.15 * F.col("factor_sanctions")).alias("base"))


def _two(name: str, x: str, cap: float) -> str:
    """SQL of one projected series of the entities: (entity, hh, median, p10, p90)."""
    return f"""{name}s AS (SELECT entity, list(x ORDER BY d) AS xs FROM (SELECT entity, date_trunc('day', ts) AS d, {x} AS x FROM sig WHERE source = 'ais' GROUP BY ALL) GROUP BY entity),
{name}l AS (SELECT entity, xs[-1] AS level0, list_transform(range(1, len(xs)), lambda i: xs[i + 1] - xs[i]) AS ds FROM {name}s WHERE len(xs) > 1),
{name}v AS (SELECT entity, level0, list_avg(ds[-3:]) AS drift, greatest(list_stddev_pop(ds), {0.05 * cap}::DOUBLE) AS vol FROM {name}l),
{name}m AS (SELECT entity, hh, vol, greatest(0, least({cap}::DOUBLE, level0 + drift * (1 - pow({REVERSION}::DOUBLE, hh / 6)) / (1 - {REVERSION}::DOUBLE))) AS m FROM {name}v, (SELECT unnest({HORIZONS_H}) AS hh)),
{name} AS (SELECT entity, hh, m, greatest(0, least({cap}::DOUBLE, m - {Z90}::DOUBLE * vol * sqrt(hh / 6))) AS lo, greatest(0, least({cap}::DOUBLE, m + {Z90}::DOUBLE * vol * sqrt(hh / 6))) AS hi FROM {name}m)"""


_FUTURES = {"base": ("1", "1"), "resolves": ("exp(-hh / 72.0::DOUBLE)", "exp(-hh / 72.0::DOUBLE)"), "cheap_oil": ("1", "0.1::DOUBLE"), "other_supply": ("0.65::DOUBLE", "0.65::DOUBLE")}
_CROSSING = CUR_SQL + ",\n" + _two("av", "avg(anomaly) * 5", 10.0) + ",\n" + _two("bv", "avg(k) / 100", 1.0) + """,
f(type, fa, fb, hh) AS (""" + " UNION ALL ".join(f"SELECT '{t}', {a}, {b}, hh FROM (SELECT unnest({HORIZONS_H}) AS hh)" for t, (a, b) in _FUTURES.items()) + """),
c AS (SELECT entity, 0.25::DOUBLE * factor_gdelt + 0.15::DOUBLE * factor_sanctions AS base FROM cur),
u AS (SELECT entity, hh, path, ('0x' || substr(md5(entity || ':' || hh || ':' || path || ':11'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM av, range(0, 500) r(path)),
d AS (SELECT f.type, u.entity, u.path, min(u.hh) FILTER (least(1, 0.35::DOUBLE * least(1, greatest(0, (av.lo * fa + u * (av.hi * fa - av.lo * fa)) / 5)) + 0.25::DOUBLE * least(1, greatest(0, bv.lo * fb + u * (bv.hi * fb - bv.lo * fb))) + base) > 0.2634::DOUBLE) AS h
  FROM u JOIN av USING (entity, hh) JOIN bv USING (entity, hh) JOIN c USING (entity) JOIN f ON f.hh = u.hh GROUP BY ALL),
x AS (SELECT type, entity, count(h) / 500 AS p, list(h ORDER BY h) FILTER (h IS NOT NULL) AS hs FROM d GROUP BY ALL),
y AS (SELECT t.type, c.entity, coalesce(p, 0) AS p, hs FROM c CROSS JOIN (SELECT DISTINCT type FROM f) t LEFT JOIN x ON x.type = t.type AND x.entity = c.entity)"""  # fmt: skip
_AT = lambda q: f"coalesce(hs[CAST(floor({q}::DOUBLE * len(hs)) AS INTEGER) + 1]::DOUBLE, 'inf'::DOUBLE)"


@query("crossing_mc", _CROSSING + f" SELECT CAST(entity AS INTEGER) AS entity, p AS probability, {_AT(0.5)} AS median_h, {_AT(0.1)} AS p10_h, {_AT(0.9)} AS p90_h FROM y WHERE type = 'base'")
def crossing_mc(spark, sf_dir):
    """Crossing probability by 500 paths; the draws are hashes."""
    from ..operators.sandbox import crossing

    return crossing(*_bands(spark, sf_dir))


@query("counterfactuals", _CROSSING + " SELECT CAST(a.entity AS INTEGER) AS entity, a.type, a.p AS probability, round(a.p - b.p, 9) AS delta FROM y a JOIN y b ON b.entity = a.entity AND b.type = 'base' WHERE a.type <> 'base'")
def counterfactuals(spark, sf_dir):
    from ..operators.sandbox import counterfactuals as futures

    return futures(*_bands(spark, sf_dir)).withColumn("delta", F.round("delta", 9))


@query("fork_wiring")
def fork_wiring(spark, sf_dir):
    """Entities that cross with a confidence of one half or more, each with the cascade of its projected severity."""
    from ..operators.sandbox import crossing, severity_24h

    bands, base = _bands(spark, sf_dir)
    sure = crossing(bands, base).where("probability >= 0.5").select("entity", "probability")
    s = bands.where("hours = 24").select("entity", severity_24h(F.col("a50"), F.col("b50")).alias("severity")).join(sure, "entity")
    default = scenario.scenarios(spark, [{"scenario": "fork", "profile": "escalating"}]).drop("scenario", "fraction")
    forks = s.crossJoin(F.broadcast(default)).withColumn("scenario", F.col("entity").cast("string")).withColumn("fraction", F.greatest("severity", F.lit(0.3)))
    return scenario.summary(forks).select(F.col("scenario").cast("int").alias("entity"), "gap", "gap_days", "spr_day", "price_lo", "price_hi").join(s.select("entity", "severity", "probability"), "entity")


def _drawn(n: int = 300, seed: int = 7) -> list[dict]:
    """A fixed number of small rows, drawn on the driver."""
    r = random.Random(seed)
    return [{"scenario": f"d{i}", "fraction": min(1.0, max(0.0, r.gauss(0.8, 0.1))), "ramp_days": max(1.0, r.gauss(5, 1.5)), "bypass": 4.0 * r.uniform(0.85, 1.15), "share_pct": 42.5 * r.uniform(0.85, 1.15)} for i in range(n)]


_GAPS = "WITH RECURSIVE " + _values(_drawn()) + "," + CASCADE_SQL + """,
z AS (SELECT list(gap ORDER BY gap) AS g FROM (SELECT scenario, max(round(net, 4)) AS gap FROM loop_ GROUP BY scenario)),
q AS (SELECT g[CAST(floor(0.1::DOUBLE * len(g)) AS INTEGER) + 1] AS p10, list_median(g) AS p50, g[least(CAST(floor(0.9::DOUBLE * len(g)) AS INTEGER), len(g) - 1) + 1] AS p90 FROM z)"""


@query("mc_bands", _GAPS + " SELECT p10, round(p50, 6) AS p50, p90 FROM q")
def mc_bands(spark, sf_dir):
    """Uncertainty bands over 300 seeded draws."""
    s = scenario.summary(scenario.scenarios(spark, _drawn()))
    a = s.agg(F.sort_array(F.collect_list("gap")).alias("g"), F.median("gap").alias("p50"))
    return a.select(F.expr("g[cast(floor(0.1D * size(g)) as int)]").alias("p10"), F.round("p50", 6).alias("p50"), F.expr("g[least(cast(floor(0.9D * size(g)) as int), size(g) - 1)]").alias("p90"))


@query("fan_bands", _GAPS.replace("p(scenario", "p0(scenario", 1).replace("FROM p)", "FROM p0)", 1) + """,
k1 AS (SELECT * FROM loop_ WHERE scenario = 'd0')
SELECT CAST(day AS INTEGER) AS day, round(round(net, 4), 3) AS p50, round(round(net, 4) * p10 / CASE WHEN p50 = 0 THEN 1 ELSE p50 END, 3) AS p10, round(round(net, 4) * p90 / CASE WHEN p50 = 0 THEN 1 ELSE p50 END, 3) AS p90 FROM k1, q""")
def fan_bands(spark, sf_dir):
    """A scenario's daily gap with the drawn bands scaled to it by their ratios to the median."""
    q = mc_bands(spark, sf_dir).select(F.col("p10").alias("q10"), F.col("p50").alias("q50"), F.col("p90").alias("q90"))
    d = scenario.daily(scenario.scenarios(spark, _drawn()[:1])).select("day", F.round("net", 4).alias("gap")).crossJoin(F.broadcast(q))
    by = F.when(F.col("q50") == 0, 1.0).otherwise(F.col("q50"))
    return d.select("day", F.round("gap", 3).alias("p50"), F.round(F.col("gap") * F.col("q10") / by, 3).alias("p10"), F.round(F.col("gap") * F.col("q90") / by, 3).alias("p90"))


#: Metrics of the comparison and their units.
COMPARED = {"gap": " mbpd", "price_hi": " $/bbl", "gdp_pct": "%", "spr_day": " d", "gap_days": " d"}


@query("run_compare", _HEAD + _SUMMARY + """,
m AS (SELECT scenario, round((price_lo + price_hi) / 2 * gdp_per_usd, 3) AS gdp_pct, gap, price_hi, spr_day, gap_days::DOUBLE AS gap_days FROM h),
w AS (SELECT r.label, r.pos, m.* FROM (VALUES ('Baseline', 0, 'strait_full'), ('run 7', 1, 'less_demand'), ('run 8', 2, 'producers_cut'), ('run 9', 3, 'nothing')) r(label, pos, scenario) JOIN m USING (scenario))
SELECT metric, max(v) FILTER (pos = 0) AS baseline, max(v) FILTER (pos = 1) AS run_1, max(v) FILTER (pos = 2) AS run_2, max(v) FILTER (pos = 3) AS run_3 FROM (
  SELECT pos, x.metric, printf('%.2f', round(x.v, 2) + 0.0::DOUBLE) || x.unit AS v FROM w, LATERAL (VALUES """ + ", ".join(f"('{k}', {k}::DOUBLE, '{u}')" for k, u in COMPARED.items()) + """) x(metric, v, unit)) GROUP BY metric""")
def run_compare(spark, sf_dir):
    """The baseline and the last three runs side by side, a metric a row."""
    runs = [r["scenario"] for r in PRESETS[1:]][-3:]
    s = scenario.summary(presets(spark)).where(F.col("scenario").isin("strait_full", *runs))
    name = F.when(F.col("scenario") == "strait_full", "baseline").otherwise(F.concat(F.lit("run_"), F.array_position(F.array(*map(F.lit, runs)), F.col("scenario"))))
    long = s.select(name.alias("run"), *[F.col(c).cast("double").alias(c) for c in COMPARED]).unpivot(["run"], list(COMPARED), "metric", "v")
    unit = F.coalesce(*[F.when(F.col("metric") == k, F.lit(u)) for k, u in COMPARED.items()])
    # a negative zero is told as zero
    shown = F.concat(F.format_string("%.2f", F.round("v", 2) + 0.0), unit)
    return long.select("metric", "run", shown.alias("v")).groupBy("metric").pivot("run", ["baseline", "run_1", "run_2", "run_3"]).agg(F.first("v"))


@query("scenario_assembly", CUR_SQL + """,
o(entity, fraction) AS (VALUES (3, 0.6::DOUBLE), (7, NULL::DOUBLE), (9, 1.4::DOUBLE))
SELECT entity, round(least(1, greatest(0, coalesce(o.fraction, CASE WHEN score >= 0.18 THEN score END, 1.0::DOUBLE))), 9) AS fraction, round(95 * (1 + factor_price * 0.1::DOUBLE), 9) AS price, greatest(CAST(round(score * 100) AS INTEGER) + 30, 90) AS horizon, round(5.25::DOUBLE * 0.886::DOUBLE * score, 9) AS dependency FROM cur LEFT JOIN o USING (entity)""")  # fmt: skip
def scenario_assembly(spark, sf_dir):
    """Parameters by precedence: override, then live state, then default."""
    o = spark.createDataFrame([(3, 0.6), (7, None), (9, 1.4)], "entity int, override double")
    s = F.col("score")
    return current_scores(spark, sf_dir).join(F.broadcast(o), "entity", "left").select(
        "entity", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("override", F.when(s >= 0.18, s), F.lit(1.0)))), 9).alias("fraction"), F.round(95 * (1 + F.col("factor_price") * 0.1), 9).alias("price"),
        F.greatest(F.round(s * 100).cast("int") + 30, F.lit(90)).alias("horizon"), F.round(F.lit(5.25) * 0.886 * s, 9).alias("dependency"))
