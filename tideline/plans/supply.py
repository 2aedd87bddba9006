"""Suppliers, routes, grades, ranking, ledgers, snapshots and lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import RISK_MAX, TOPSIS_WEIGHTS
from ..functions.scores import corridor_status, grade_compatibility
from ..operators import ledger, procurement, upsert
from ..sources.views import table
from ..workspace import Workspace
from .registry import query
from .risk import CUR_SQL, current_scores


def nation_risk(spark, sf_dir):
    return current_scores(spark, sf_dir).select(F.col("entity").alias("nation"), F.col("score").alias("risk"))


@query("suppliers_available", CUR_SQL + f" SELECT s_suppkey, s_name, score AS risk FROM supplier LEFT JOIN cur ON entity = s_nationkey WHERE coalesce(s_acctbal < 0, FALSE) = FALSE AND (score IS NULL OR score < 0.29) ORDER BY risk NULLS LAST, s_suppkey")
def suppliers_available(spark, sf_dir):
    """Suppliers that are not barred and whose nation's risk, if known, is below the limit."""
    s = table(spark, sf_dir, "supplier").where(~F.coalesce(F.col("s_acctbal") < 0, F.lit(False)))
    j = s.join(nation_risk(spark, sf_dir), F.col("s_nationkey") == F.col("nation"), "left").where("risk is null or risk < 0.29")
    return j.select("s_suppkey", "s_name", "risk").orderBy(F.asc_nulls_last("risk"), "s_suppkey")


@query("routes_open", CUR_SQL + " SELECT n_name AS corridor, score AS risk, CASE WHEN coalesce(score, 0) >= 0.7 THEN 'BLOCKED' WHEN coalesce(score, 0) >= 0.45 THEN 'CONTESTED' ELSE 'NOMINAL' END AS status FROM nation LEFT JOIN cur ON entity = n_nationkey AND score >= 0.1 WHERE score IS NULL OR score < 0.5")
def routes_open(spark, sf_dir):
    r = nation_risk(spark, sf_dir).where("risk >= 0.1")  # in the join's condition: a corridor without such a state stays
    j = table(spark, sf_dir, "nation").join(r, F.col("n_nationkey") == F.col("nation"), "left").where(f"risk is null or risk < {RISK_MAX}")
    return j.select(F.col("n_name").alias("corridor"), "risk", corridor_status(F.col("risk")).alias("status"))


@query("grade_specs", "SELECT s_nationkey AS nation, p_type AS grade, count(DISTINCT p_partkey) AS parts, round(avg(p_size), 6) AS api FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size >= 20 GROUP BY ALL")
def grade_specs(spark, sf_dir):
    pair = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    j = pair.join(table(spark, sf_dir, "part").where("p_size >= 20"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("s_nationkey").alias("nation"), F.col("p_type").alias("grade")).agg(F.countDistinct("p_partkey").alias("parts"), F.round(F.avg("p_size"), 6).alias("api"))


_COMPAT = "CASE WHEN p_partkey % 17 = 0 THEN 0.77::DOUBLE WHEN p_partkey % 19 = 0 THEN 0.5::DOUBLE ELSE round(greatest(0, least(1, 0.6::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * exp(-0.5::DOUBLE * pow((p_size - 32) / 8.0::DOUBLE, 2))) + 0.4::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * exp(-0.5::DOUBLE * pow((p_retailprice % 5 - 1.8::DOUBLE) / 0.25::DOUBLE, 2))))), 4) END"


@query("grade_compat", f"SELECT p_partkey, {_COMPAT} AS compat FROM part")
def grade_compat(spark, sf_dir):
    c = F.col
    known = F.when(c("p_partkey") % 17 == 0, 0.77)
    spec = F.when(c("p_partkey") % 19 != 0, 32.0)
    return table(spark, sf_dir, "part").select("p_partkey", grade_compatibility(c("p_size").cast("double"), c("p_retailprice") % 5, spec, F.lit(1.8), known).alias("compat"))


@query("marker_grade", "SELECT p_brand AS origin, arg_min(p_type, p_partkey) AS grade, min(p_partkey) AS first FROM part GROUP BY p_brand")
def marker_grade(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("origin")).agg(F.min_by("p_type", "p_partkey").alias("grade"), F.min("p_partkey").alias("first"))


@query("routing_best", CUR_SQL + """,
c AS (SELECT n_name AS corridor, coalesce(score, 0) AS risk FROM nation LEFT JOIN cur ON entity = n_nationkey WHERE n_nationkey <> 4),
g AS (SELECT sum(coalesce(score, 0)) / 5 AS congestion FROM cur WHERE entity IN (1, 2, 3, 5, 8)),
s AS (SELECT s_suppkey AS supplier, 'NATION_' || s_nationkey AS corridor, 1 + s_suppkey % 4 AS freight, 10.0::DOUBLE + s_suppkey % 20 AS base_days, 0.5::DOUBLE + (s_suppkey % 6) / 10.0::DOUBLE AS availability FROM supplier),
k AS (SELECT *, 0.0::DOUBLE AS premium, 0.0::DOUBLE AS added, 0 AS seq FROM s
  UNION ALL SELECT supplier, 'NATION_' || ((supplier + 7) % 25), freight, base_days, availability, 0.05::DOUBLE * (supplier % 9), 6.0::DOUBLE, 1 FROM s WHERE supplier % 3 = 0),
j AS (SELECT k.*, c.risk AS known, coalesce(c.risk, 0.1::DOUBLE) AS risk, round(g.congestion * 3, 2) AS wait FROM k LEFT JOIN c USING (corridor), g WHERE c.risk IS NULL OR c.risk <= 0.5),
o AS (SELECT *, round(95 + freight + premium + CASE WHEN known IS NULL AND seq = 0 THEN 0 ELSE greatest(0, risk - 0.3::DOUBLE) / 0.5::DOUBLE * 0.8::DOUBLE END + round(wait * 35000 / 2000000, 4), 2) AS landed, round(base_days + added + wait + round(5 * greatest(0, 1 - availability), 2), 1) AS lead FROM j)
SELECT supplier, corridor, landed, lead, risk, seq = 1 AS bypass FROM o QUALIFY row_number() OVER (PARTITION BY supplier ORDER BY landed, seq, corridor) = 1""")  # fmt: skip
def routing_best(spark, sf_dir):
    c = F.col
    names = table(spark, sf_dir, "nation").where("n_nationkey <> 4")
    risk = Workspace(spark, "risk").save(nation_risk(spark, sf_dir))  # a row a nation, read twice
    corridors = names.join(risk, c("n_nationkey") == c("nation"), "left").select(c("n_name").alias("corridor"), "risk")
    congestion = risk.where("nation in (1, 2, 3, 5, 8)").agg((F.coalesce(F.sum("risk"), F.lit(0.0)) / 5).alias("congestion"))
    k = c("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("supplier"), F.concat(F.lit("NATION_"), "s_nationkey").alias("corridor"), (1 + k % 4).cast("double").alias("freight"), (10 + k % 20).cast("double").alias("base_days"), (0.5 + (k % 6) / 10.0).alias("availability"))
    b = table(spark, sf_dir, "supplier").where(k % 3 == 0).select(k.alias("supplier"), F.concat(F.lit("NATION_"), ((k + 7) % 25).cast("string")).alias("corridor"), (0.05 * (k % 9)).alias("premium"), F.lit(6.0).alias("added_days"))
    return procurement.best_routes(s, b, corridors, congestion)


_OPT = CUR_SQL + """,
opt AS (SELECT s_suppkey AS supplier, avg(l_extendedprice / l_quantity) AS cost, avg(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS lead, avg(p_size) / 50 AS compat, coalesce(any_value(score), 0.1::DOUBLE) AS risk
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN cur ON entity = s_nationkey GROUP BY s_suppkey)"""  # fmt: skip


def options(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    j = li.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("cost"), F.avg(F.datediff("l_shipdate", "o_orderdate")).alias("lead"), (F.avg("p_size") / 50).alias("compat"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"))
    return g.join(s, "supplier").join(nation_risk(spark, sf_dir), "nation", "left").withColumn("risk", F.coalesce("risk", F.lit(0.1))).drop("nation")


@query("topsis", _OPT + """,
e AS (SELECT min(cost) c0, max(cost) c1, min(lead) l0, max(lead) l1, min(compat) g0, max(compat) g1, min(risk) r0, max(risk) r1 FROM opt),
u AS (SELECT supplier, (cost - c0) / (c1 - c0) AS c, (lead - l0) / (l1 - l0) AS l, (compat - g0) / (g1 - g0) AS g, (risk - r0) / (r1 - r0) AS r FROM opt, e),
d AS (SELECT *, sqrt(0.35::DOUBLE * c * c + 0.25::DOUBLE * l * l + 0.25::DOUBLE * (g - 1) * (g - 1) + 0.15::DOUBLE * r * r) AS good, sqrt(0.35::DOUBLE * (c - 1) * (c - 1) + 0.25::DOUBLE * (l - 1) * (l - 1) + 0.25::DOUBLE * g * g + 0.15::DOUBLE * (r - 1) * (r - 1)) AS bad FROM u)
SELECT supplier, round(bad / (good + bad), 4) AS score, round(1 - c, 4) AS cost_score, round(1 - l, 4) AS lead_score, round(g, 4) AS compat_score, round(1 - r, 4) AS risk_score FROM d""")  # fmt: skip
def topsis(spark, sf_dir):
    return procurement.topsis(options(spark, sf_dir), "supplier").select("supplier", "score", *[f"{n}_score" for n in TOPSIS_WEIGHTS])


@query("suppliers_verified", "SELECT s_suppkey, s_name, n_name AS country FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'N')")
def suppliers_verified(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(seen, "s_suppkey", "left_semi").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", F.col("n_name").alias("country"))


@query("reserve_totals", "WITH b AS (SELECT s_nationkey, s_acctbal AS fill, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1) SELECT count(*) AS caverns, round(sum(greatest(fill, 0)), 6) AS fill, round(sum(greatest(fill, 0)) / (count(*) * 10000), 9) AS ratio FROM b")
def reserve_totals(spark, sf_dir):
    b = procurement.best_by(table(spark, sf_dir, "supplier"), "s_nationkey", [F.desc("s_acctbal"), F.col("s_suppkey")])
    fill = F.sum(F.greatest("s_acctbal", F.lit(0.0)))
    return b.agg(F.count("*").alias("caverns"), F.round(fill, 6).alias("fill"), F.round(fill / (F.count("*") * 10000), 9).alias("ratio"))


@query("plant_demand", "SELECT c_nationkey AS plant, round(sum(CASE WHEN u > 1 THEN cap * u / 100 ELSE cap * u END * 0.136::DOUBLE), 6) AS demand, round(avg(cap), 1) AS stock FROM (SELECT c_nationkey, abs(c_acctbal) / 10000 AS cap, 0.6::DOUBLE + (c_custkey % 5) / 10.0::DOUBLE + CASE WHEN c_custkey % 50 = 0 THEN 0.45 ELSE 0 END AS u FROM customer) GROUP BY 1")
def plant_demand(spark, sf_dir):
    """Demand of plants; a utilisation above 1 is read as a percentage."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", (F.abs("c_acctbal") / 10000).alias("cap"), (0.6 + (F.col("c_custkey") % 5) / 10.0 + F.when(F.col("c_custkey") % 50 == 0, 0.45).otherwise(0.0)).alias("u"))
    part = F.when(F.col("u") > 1, F.col("cap") * F.col("u") / 100).otherwise(F.col("cap") * F.col("u")) * 0.136
    return c.groupBy(F.col("c_nationkey").alias("plant")).agg(F.round(F.sum(part), 6).alias("demand"), F.round(F.avg("cap"), 1).alias("stock"))


@query("port_congestion", CUR_SQL + ", p(port) AS (VALUES (1), (2), (3), (5), (99)) SELECT round(sum(coalesce(score, 0)) / 5, 9) AS congestion, count(score) AS known FROM p LEFT JOIN cur ON entity = port")
def port_congestion(spark, sf_dir):
    p = spark.createDataFrame([(1,), (2,), (3,), (5,), (99,)], "nation int")
    return p.join(nation_risk(spark, sf_dir), "nation", "left").agg(F.round(F.sum(F.coalesce("risk", F.lit(0.0))) / 5, 9).alias("congestion"), F.count("risk").alias("known"))


# ---- snapshots --------------------------------------------------------------------------

_OLD = "old AS (SELECT c_custkey AS id, lower(trim(c_name)) AS name, c_mktsegment AS kind, c_acctbal AS v FROM customer WHERE c_custkey % 7 <> 0)"
_NEW = "new_ AS (SELECT c_custkey AS id, lower(trim(c_name)) AS name, CASE WHEN c_custkey % 11 = 0 THEN 'MOVED' ELSE c_mktsegment END AS kind, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END END AS v FROM customer WHERE c_custkey % 9 <> 0)"


def snapshots(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, name = F.col("c_custkey"), F.lower(F.trim("c_name")).alias("name")
    old = c.where(k % 7 != 0).select(k.alias("id"), name, F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("v"))
    new = c.where(k % 9 != 0).select(k.alias("id"), name, F.when(k % 11 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("kind"), F.when(k % 13 != 0, F.col("c_acctbal") + F.when(k % 5 == 0, 1.0).otherwise(0.0)).alias("v"))
    return old, new


@query("sanctions_diff", f"WITH {_OLD}, {_NEW} SELECT name, kind, 'add' AS change FROM new_ ANTI JOIN old USING (name, kind) UNION ALL SELECT name, kind, 'remove' FROM old ANTI JOIN new_ USING (name, kind)")
def sanctions_diff(spark, sf_dir):
    return upsert.list_diff(*snapshots(spark, sf_dir), ["name", "kind"])


@query("list_except", f"WITH {_OLD}, {_NEW} SELECT 'added' AS side, count(*) AS n FROM (SELECT name, kind FROM new_ EXCEPT SELECT name, kind FROM old) UNION ALL SELECT 'removed', count(*) FROM (SELECT name, kind FROM old EXCEPT SELECT name, kind FROM new_)")
def list_except(spark, sf_dir):
    old, new = (x.select("name", "kind") for x in snapshots(spark, sf_dir))
    return new.subtract(old).agg(F.lit("added").alias("side"), F.count("*").alias("n")).unionByName(old.subtract(new).agg(F.lit("removed").alias("side"), F.count("*").alias("n")))


@query("sanctions_relevant", "SELECT c_custkey, nullif(regexp_extract(c_name, '([0-9]{9})', 1), '') AS mmsi, c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') OR regexp_matches(lower(c_name), '0000[0-4]') AS relevant FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') OR regexp_matches(lower(c_name), '0000[0-4]')")
def sanctions_relevant(spark, sf_dir):
    hit = F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY") | F.lower("c_name").rlike("0000[0-4]")
    return table(spark, sf_dir, "customer").where(hit).select("c_custkey", F.nullif(F.regexp_extract("c_name", "([0-9]{9})", 1), F.lit("")).alias("mmsi"), F.lit(True).alias("relevant"))


@query("bundle_diff", f"WITH {_OLD}, {_NEW} SELECT n.id, o.id IS NULL AS is_new FROM new_ n LEFT JOIN old o USING (id) WHERE o.id IS NULL OR n.kind IS DISTINCT FROM o.kind OR n.v IS DISTINCT FROM o.v")
def bundle_diff(spark, sf_dir):
    return upsert.changed(*snapshots(spark, sf_dir), "id", ["kind", "v"])


@query("node_upsert", f"WITH {_OLD}, {_NEW} SELECT id, coalesce(n.name, o.name) AS name, coalesce(n.kind, o.kind) AS kind, coalesce(n.v, o.v) AS v FROM old o FULL JOIN new_ n USING (id)")
def node_upsert(spark, sf_dir):
    return upsert.attributes(*snapshots(spark, sf_dir), "id")


@query("latest_output", "SELECT o_custkey AS id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest, max(o_orderdate) AS updated FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01' GROUP BY 1")
def latest_output(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate > timestamp_ntz'1995-01-01'")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.max("o_orderdate").alias("updated"))


_TIER = "CASE WHEN p_partkey % 10 = 0 THEN 'guess' WHEN p_partkey % 3 = 0 THEN 'real' WHEN p_partkey % 3 = 1 THEN 'derived' ELSE 'estimated' END"


def tiered(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").withColumn("tier", F.when(k % 10 == 0, "guess").when(k % 3 == 0, "real").when(k % 3 == 1, "derived").otherwise("estimated"))


@query("bundle_summary", f"SELECT p_type AS kind, count(*) AS n, count(*) FILTER (t = 'real') AS real, count(*) FILTER (t = 'derived') AS derived, count(*) FILTER (t = 'estimated') AS estimated FROM (SELECT p_type, {_TIER} AS t FROM part) GROUP BY 1")
def bundle_summary(spark, sf_dir):
    return tiered(spark, sf_dir).groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"), *[F.count_if(F.col("tier") == t).alias(t) for t in ("real", "derived", "estimated")])


@query("bundle_validate", f"SELECT p_partkey AS id, 'tier' AS problem FROM (SELECT p_partkey, {_TIER} AS t FROM part) WHERE t NOT IN ('real', 'derived', 'estimated') UNION ALL SELECT p_partkey, 'source' FROM part WHERE p_brand NOT IN (SELECT 'Brand#' || n FROM range(1, 5) r(n))")
def bundle_validate(spark, sf_dir):
    p = tiered(spark, sf_dir)
    sources = spark.range(1, 5).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("p_brand"))
    return p.where(~F.col("tier").isin("real", "derived", "estimated")).select(F.col("p_partkey").alias("id"), F.lit("tier").alias("problem")).unionByName(p.join(F.broadcast(sources), "p_brand", "left_anti").select(F.col("p_partkey").alias("id"), F.lit("source").alias("problem")))


@query("params_with_override", "WITH p(param, value) AS (VALUES ('brent', 95.0::DOUBLE), ('freight', 4.0::DOUBLE), ('fill', 0.4::DOUBLE)), o(param, value, as_of) AS (VALUES ('brent', 88.5::DOUBLE, 1), ('brent', 91.25::DOUBLE, 2)) SELECT p.param, coalesce(o.value, p.value) AS value, o.value IS NOT NULL AS overridden FROM p LEFT JOIN (SELECT param, arg_max(value, as_of) AS value FROM o GROUP BY 1) o USING (param)")
def params_with_override(spark, sf_dir):
    p = spark.createDataFrame([("brent", 95.0), ("freight", 4.0), ("fill", 0.4)], "param string, value double")
    o = spark.createDataFrame([("brent", 88.5, 1), ("brent", 91.25, 2)], "param string, value double, as_of int").groupBy("param").agg(F.max_by("value", "as_of").alias("live"))
    return p.join(F.broadcast(o), "param", "left").select("param", F.coalesce("live", "value").alias("value"), F.col("live").isNotNull().alias("overridden"))


# ---- ledgers ----------------------------------------------------------------------------

_LEDGER = """WITH r AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS realized, avg(l_quantity) AS q FROM lineitem GROUP BY 1),
led AS (SELECT c_nationkey AS entity, o_orderkey AS id, o_totalprice AS predicted, realized, 25.0::DOUBLE AS predicted_q, q AS realized_q FROM orders JOIN r ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey)"""


def ledger_rows(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("realized"), F.avg("l_quantity").alias("realized_q"))
    o = table(spark, sf_dir, "orders").join(r, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").alias("entity"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("predicted"), "realized", F.lit(25.0).alias("predicted_q"), "realized_q")


@query("accuracy_metrics", _LEDGER + """, u AS (SELECT 'price' AS axis, predicted AS p, realized AS r FROM led UNION ALL SELECT 'quantity', predicted_q, realized_q FROM led)
SELECT axis, count(*) AS n, round(avg(abs(p - r) / abs(r)) * 100, 6) AS mape, round(avg(2 * abs(p - r) / (abs(p) + abs(r))) * 100, 6) AS smape, round(avg(abs(p - r)), 6) AS mae, round(sqrt(avg((p - r) * (p - r))), 6) AS rmse, round(avg(r - p), 6) AS bias FROM u GROUP BY axis""")  # fmt: skip
def accuracy_metrics(spark, sf_dir):
    return ledger.accuracy(ledger_rows(spark, sf_dir), {"price": ("predicted", "realized"), "quantity": ("predicted_q", "realized_q")})


@query("accuracy_by_entity", _LEDGER + " SELECT entity, count(*) AS n, round(avg(abs(predicted - realized) / abs(realized)) * 100, 6) AS mape FROM led GROUP BY entity")
def accuracy_by_entity(spark, sf_dir):
    return ledger.accuracy(ledger_rows(spark, sf_dir), {"price": ("predicted", "realized")}, "entity").select("entity", "n", "mape")


@query("calibration_factors", _LEDGER + " SELECT entity, round(least(1.5::DOUBLE, greatest(0.5::DOUBLE, avg(realized / predicted))), 6) AS factor FROM led GROUP BY entity HAVING count(*) >= 20")
def calibration_factors(spark, sf_dir):
    return ledger.calibration(ledger_rows(spark, sf_dir), "predicted", "realized").withColumn("factor", F.round("factor", 6))


@query("savings", _LEDGER + " SELECT round(sum(predicted - realized), 2) AS total, count(*) FILTER (predicted > realized) AS positive, count(*) AS n, round(avg(predicted - realized), 6) AS mean FROM led")
def savings(spark, sf_dir):
    d = F.col("predicted") - F.col("realized")
    return ledger_rows(spark, sf_dir).agg(F.round(F.sum(d), 2).alias("total"), F.count_if(d > 0).alias("positive"), F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean"))


@query("scenario_library", "WITH o AS (SELECT o_orderkey AS id, o_orderdate AS at_, o_orderpriority AS origin FROM orders), t AS (SELECT * FROM o ORDER BY at_ DESC, id LIMIT 60) SELECT id, origin, FALSE AS custom FROM (SELECT * FROM t WHERE origin <> '5-LOW' ORDER BY at_ DESC, id LIMIT 20) UNION ALL SELECT -1, 'preset', TRUE")
def scenario_library(spark, sf_dir):
    """The newest 60, of these the first 20 of the wanted origins, and the custom one."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t"), F.col("o_orderpriority").alias("origin")).orderBy(F.desc("t"), "id").limit(60)
    first = t.where("origin <> '5-LOW'").orderBy(F.desc("t"), "id").limit(20).select("id", "origin", F.lit(False).alias("custom"))
    return first.unionByName(spark.createDataFrame([(-1, "preset", True)], "id long, origin string, custom boolean"))


@query("response_time", """WITH r AS (SELECT event_id AS run, user_id, ts AS t0, ts + INTERVAL (value) SECOND AS t1 FROM events WHERE event_type = 'signup'),
x AS (SELECT r.run, count(e.event_id) AS traced, any_value(epoch(r.t1) - epoch(r.t0)) AS took, any_value(r.t0) AS t0 FROM r LEFT JOIN events e ON e.user_id = r.user_id AND e.event_type <> 'signup' AND e.ts BETWEEN r.t0 AND r.t1 + INTERVAL 5 SECOND GROUP BY r.run)
SELECT (SELECT sum(traced) FROM x)::BIGINT AS traced, round((SELECT median(took) FROM (SELECT took FROM x ORDER BY t0 DESC, run LIMIT 5)), 6) AS median_s""")  # fmt: skip
def response_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    r = e.where("event_type = 'signup'").select(F.col("event_id").alias("run"), F.col("user_id").alias("u"), F.col("t").alias("t0"), (F.col("t") + F.col("value")).alias("t1"))
    traced = ledger.traces(r, e.where("event_type <> 'signup'").select(F.col("user_id").alias("u"), "t", "event_id"), 5.0, 600)
    last = r.orderBy(F.desc("t0"), "run").limit(5).agg(F.round(F.median(F.col("t1") - F.col("t0")), 6).alias("median_s"))
    return traced.agg(F.sum("traced").alias("traced")).crossJoin(F.broadcast(last))


@query("roc_youden", """WITH s AS (SELECT quality AS y, n_chars AS x FROM labels JOIN documents USING (doc_id)), g AS (SELECT x, sum(y) AS p, count(*) - sum(y) AS n FROM s GROUP BY x),
c AS (SELECT x, sum(p) OVER (ORDER BY x DESC) / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY x DESC) / sum(n) OVER () AS fpr, p, n FROM g),
a AS (SELECT *, coalesce(lag(tpr) OVER (ORDER BY x DESC), 0) AS t0, coalesce(lag(fpr) OVER (ORDER BY x DESC), 0) AS f0 FROM c)
SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 9) AS auc, arg_max(x, (round(tpr - fpr, 9), x)) AS threshold, round(max(tpr - fpr), 9) AS j FROM a""")  # fmt: skip
def roc_youden(spark, sf_dir):
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").alias("x"))
    return ledger.roc(s)


@query("pipeline_eligible", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3) OR n_nationkey % 6 = 0")
def pipeline_eligible(spark, sf_dir):
    labels = F.array(F.concat(F.lit("R"), "n_regionkey"), F.concat(F.lit("N"), (F.col("n_nationkey") % 6).cast("string")))
    return table(spark, sf_dir, "nation").where(F.arrays_overlap(labels, F.array(F.lit("R1"), F.lit("R3"), F.lit("N0")))).select("n_nationkey", "n_name")


@query("shipping_rank", "SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 3")
def shipping_rank(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("l_suppkey", "l_orderkey", "rank")
