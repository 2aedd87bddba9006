"""Graph queries over trade flows between nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CASCADE_FLOOR
from ..operators import graph
from ..sources.views import CTE, flows, strong_edges, table
from ..workspace import Workspace
from .registry import query
from .risk import CUR_SQL, current_scores

GRAPH_SQL = CUR_SQL + ",\n" + CTE["flow"] + ",\n" + CTE["edge"]
EDGE_SQL = "WITH RECURSIVE " + CTE["flow"] + ",\n" + CTE["edge"]


def scored(spark, sf_dir):
    return current_scores(spark, sf_dir).select(F.col("entity").alias("node"), "score")


@query("supply_chain_index", GRAPH_SQL + """,
deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1),
j AS (SELECT entity AS node, score, greatest(coalesce(degree, 1), 1) AS w FROM cur LEFT JOIN deg ON node = entity)
SELECT node, round(sum(w * score) OVER () / sum(w) OVER (), 9) AS index, round(w * score / sum(w * score) OVER (), 9) AS share FROM j ORDER BY w * score DESC, node LIMIT 6""")  # fmt: skip
def supply_chain_index(spark, sf_dir):
    out = graph.index(scored(spark, sf_dir), graph.degrees(strong_edges(spark, sf_dir)))
    return out.orderBy(F.desc(F.col("w") * F.col("score")), "node").limit(6).select("node", F.round("index", 9).alias("index"), F.round("share", 9).alias("share"))


@query("degree_hubs", EDGE_SQL + """,
deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY degree, node) - 1 AS i, count(*) OVER () AS n FROM deg)
SELECT node, degree, degree >= (SELECT max(degree) FROM n WHERE i = CAST(floor(n * 0.9) AS BIGINT)) AS hub FROM n""")  # fmt: skip
def degree_hubs(spark, sf_dir):
    d = graph.degrees(strong_edges(spark, sf_dir))
    at = d.agg(F.sort_array(F.collect_list("degree")).alias("a")).select(F.expr("a[cast(floor(size(a) * 0.9D) as int)]").alias("limit"))
    return d.crossJoin(F.broadcast(at)).select("node", "degree", (F.col("degree") >= F.col("limit")).alias("hub"))


@query("connected_names", EDGE_SQL + " SELECT DISTINCT a.n_name AS name, b.n_name AS other FROM (SELECT src, dst FROM edge UNION ALL SELECT dst, src FROM edge) e JOIN nation a ON a.n_nationkey = e.src JOIN nation b ON b.n_nationkey = e.dst")
def connected_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("name")), n.select(F.col("n_nationkey").alias("dst"), F.col("n_name").alias("other"))
    return graph.both_ways(strong_edges(spark, sf_dir)).join(a, "src").join(b, "dst").select("name", "other").distinct()


_REACH = """,
link AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edge UNION ALL SELECT dst, src FROM edge)),
walk AS (SELECT n AS root, n AS node, 0 AS hop FROM (VALUES {roots}) r(n) UNION SELECT w.root, l.dst, w.hop + 1 FROM walk w JOIN link l ON l.src = w.node WHERE w.hop < {hops})
"""


@query("subgraph_2hop", EDGE_SQL + _REACH.format(roots="(3)", hops=2) + "SELECT node, min(hop) AS hop FROM walk GROUP BY node")
def subgraph_2hop(spark, sf_dir):
    start = spark.range(3, 4).select(F.col("id").cast("int").alias("node"))
    return graph.reach(strong_edges(spark, sf_dir), start, 2).select("node", "hop")


@query("blast_radius", EDGE_SQL + _REACH.format(roots="(1), (7), (12)", hops=2) + "SELECT root, count(DISTINCT node) - 1 AS within FROM walk GROUP BY root")
def blast_radius(spark, sf_dir):
    start = spark.createDataFrame([(1,), (7,), (12,)], "node int")
    return graph.reach(strong_edges(spark, sf_dir), start, 2).groupBy("root").agg((F.count("*") - 1).alias("within"))


_EXPOSURE = "WITH RECURSIVE " + CTE["flow"] + """,
feeds AS (SELECT f.src AS corridor, n.n_regionkey AS port, volume / sum(volume) OVER (PARTITION BY n.n_regionkey) AS share FROM flow f JOIN nation n ON n.n_nationkey = f.dst),
supplies AS (SELECT n.n_regionkey AS port, f.dst AS plant, volume / sum(volume) OVER (PARTITION BY f.dst) AS share FROM flow f JOIN nation n ON n.n_nationkey = f.src),
ff AS (SELECT corridor, port, max(share) AS f FROM feeds GROUP BY ALL), ss AS (SELECT port, plant, max(share) AS s FROM supplies GROUP BY ALL),
exposed AS (SELECT corridor, plant, sum(f * s) AS exposure FROM ff JOIN ss USING (port) GROUP BY ALL HAVING sum(f * s) > 1e-4)
"""  # fmt: skip


def exposed(spark, sf_dir):
    f = Workspace(spark, "flows").save(flows(spark, sf_dir))
    region = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("port"))

    def shares(by_dst: bool):
        j = f.join(region, F.col("dst" if by_dst else "src") == F.col("n_nationkey"))
        key = "port" if by_dst else "dst"
        total = j.groupBy(F.col(key).alias("_k")).agg(F.sum("volume").alias("_t"))
        return j.join(total, F.col(key) == F.col("_k")).withColumn("share", F.col("volume") / F.col("_t"))

    return graph.exposure(shares(True).select(F.col("src").alias("corridor"), "port", "share"), shares(False).select("port", F.col("dst").alias("plant"), "share"))


@query("exposure", _EXPOSURE + "SELECT corridor, plant, round(exposure, 9) AS exposure FROM exposed")
def exposure(spark, sf_dir):
    return exposed(spark, sf_dir).withColumn("exposure", F.round("exposure", 9))


@query("most_exposed", _EXPOSURE + "SELECT corridor, arg_max(plant, (round(exposure, 9), -plant)) AS plant, round(max(exposure), 9) AS exposure FROM exposed GROUP BY corridor")
def most_exposed(spark, sf_dir):
    e = exposed(spark, sf_dir).withColumn("exposure", F.round("exposure", 9))
    return e.groupBy("corridor").agg(F.max_by("plant", F.struct("exposure", -F.col("plant"))).alias("plant"), F.max("exposure").alias("exposure"))


@query("risk_cascade", GRAPH_SQL + f""",
link AS (SELECT src, dst, max(least(1, greatest(0, share * 10))) AS w FROM (SELECT src, dst, share FROM edge UNION ALL SELECT dst, src, share FROM edge) GROUP BY ALL),
h0 AS (SELECT entity AS origin, entity AS node, score AS value FROM cur WHERE score >= {CASCADE_FLOOR}),
h1 AS (SELECT origin, dst AS node, max(value * w) AS value FROM h0 JOIN link ON src = node WHERE value * w >= {CASCADE_FLOOR} AND dst <> origin GROUP BY ALL),
h2 AS (SELECT h1.origin, dst AS node, max(value * w) AS value FROM h1 JOIN link ON src = node WHERE value * w >= {CASCADE_FLOOR} AND dst <> h1.origin AND (h1.origin, dst) NOT IN (SELECT (origin, node) FROM h1) GROUP BY ALL),
seen AS (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2),
best AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY node ORDER BY hop, round(value, 12) DESC, origin) = 1)
SELECT node, origin, hop, round(value, 9) AS inherited FROM best JOIN cur ON entity = node WHERE round(value, 12) > score""")  # fmt: skip
def risk_cascade(spark, sf_dir):
    # flows are spread thin over many partners; ten times the share makes the main ones carry risk
    w = Workspace(spark, "cascade")  # edges and scores are few, and each hop reads them
    return graph.cascade(w.save(strong_edges(spark, sf_dir).withColumn("share", F.col("share") * 10)), w.save(scored(spark, sf_dir))).withColumn("inherited", F.round("inherited", 9))


@query("edge_dedup", """
SELECT src, dst, name, min(uuid) AS uuid FROM (SELECT s_nationkey AS src, l_linenumber AS dst, l_returnflag AS name, l_orderkey * 10 + l_linenumber AS uuid FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY ALL""")
def edge_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("src"), F.col("l_linenumber").alias("dst"), F.col("l_returnflag").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uuid"))
    return graph.dedup_edges(e)


@query("alias_merge", EDGE_SQL + """,
m AS (SELECT CASE WHEN src >= 20 THEN src - 20 ELSE src END AS src, CASE WHEN dst >= 20 THEN dst - 20 ELSE dst END AS dst, src * 100 + dst AS uuid FROM edge)
SELECT src, dst, 'SUPPLIES' AS name, min(uuid) AS uuid FROM m WHERE src <> dst GROUP BY src, dst""")  # fmt: skip
def alias_merge(spark, sf_dir):
    e = strong_edges(spark, sf_dir).select("src", "dst", F.lit("SUPPLIES").alias("name"), (F.col("src") * 100 + F.col("dst")).alias("uuid"))
    aliases = table(spark, sf_dir, "nation").where("n_nationkey >= 20").select(F.col("n_nationkey").alias("alias"), (F.col("n_nationkey") - 20).alias("canonical"))
    return graph.merge_aliases(e, aliases)


@query("edge_reconcile", "WITH RECURSIVE " + CTE["flow"] + """,
fact AS (SELECT s_nationkey AS src, c_nationkey AS dst, sum(l_quantity) AS volume FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT f.src, f.dst, coalesce(fact.volume, f.volume) AS volume, least(1.0::DOUBLE, greatest(0.0::DOUBLE, round(coalesce(fact.volume, 0) / f.volume, 9))) AS weight, fact.volume IS NOT NULL AS learned FROM flow f LEFT JOIN fact USING (src, dst)""")  # fmt: skip
def edge_reconcile(spark, sf_dir):
    """Stored values give way to facts; the learned weight is clamped to 0..1."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    fact = (
        li.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.sum("l_quantity").alias("fact"))
    )
    j = flows(spark, sf_dir).join(fact, ["src", "dst"], "left")
    return j.select("src", "dst", F.coalesce("fact", "volume").alias("volume"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(F.coalesce("fact", F.lit(0.0)) / F.col("volume"), 9))).alias("weight"), F.col("fact").isNotNull().alias("learned"))


@query("graph_facts", EDGE_SQL + """,
link AS (SELECT src, dst, max(share) AS share FROM (SELECT src, dst, share FROM edge UNION ALL SELECT dst, src, share FROM edge) GROUP BY ALL),
one AS (SELECT src AS anchor, src, dst, share, row_number() OVER (PARTITION BY src ORDER BY share DESC, dst) AS rank FROM link WHERE src IN (2, 5, 11)),
two AS (SELECT anchor, l.src, l.dst, l.share FROM one JOIN link l ON l.src = one.dst WHERE one.rank <= 20 AND l.dst <> anchor),
all_ AS (SELECT anchor, src, dst, share FROM one WHERE rank <= 20 UNION SELECT * FROM two)
SELECT anchor, src, dst, share FROM all_ QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY share DESC, src, dst) <= 20""")  # fmt: skip
def graph_facts(spark, sf_dir):
    """Up to 20 facts within two hops of each of three anchors, the strongest first."""
    e = strong_edges(spark, sf_dir)
    links = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share")).groupBy("src", "dst").agg(F.max("share").alias("share"))
    one = graph.top_links(links.where("src in (2, 5, 11)"), 20).select(F.col("src").alias("anchor"), "src", "dst", "share")
    two = one.select("anchor", F.col("dst").alias("mid")).join(links, F.col("mid") == F.col("src")).where("dst <> anchor").select("anchor", "src", "dst", "share")
    both = one.unionByName(two).distinct()
    best = both.groupBy("anchor").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("o"), "src", "dst", "share"))), 1, 20).alias("f"))
    return best.select("anchor", F.inline("f")).select("anchor", "src", "dst", "share")


@query("full_graph", GRAPH_SQL + """,
deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1)
SELECT n_nationkey AS node, n_name AS name, r_name AS region, coalesce(score, 0) AS score, coalesce(degree, 0) AS degree,
  round(n_regionkey * 20 + (('0x' || substr(md5(n_name), 1, 2))::INT / 255.0::DOUBLE - 0.5), 9) AS lat, round(n_regionkey * 30 + (('0x' || substr(md5(n_name), 3, 2))::INT / 255.0::DOUBLE - 0.5), 9) AS lon
FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN cur ON entity = n_nationkey LEFT JOIN deg ON node = n_nationkey""")  # fmt: skip
def full_graph(spark, sf_dir):
    """Nodes with registry names, coordinates by hash around their region, risk and degree."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    jitter = lambda i: F.conv(F.substring(F.md5("n_name"), i, 2), 16, 10).cast("int") / 255.0 - 0.5
    s, d = scored(spark, sf_dir), graph.degrees(strong_edges(spark, sf_dir))
    j = n.withColumn("node", F.col("n_nationkey")).join(s, "node", "left").join(d, "node", "left")
    return j.select("node", F.col("n_name").alias("name"), F.col("r_name").alias("region"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("degree", F.lit(0)).alias("degree"), F.round(F.col("n_regionkey") * 20 + jitter(1), 9).alias("lat"), F.round(F.col("n_regionkey") * 30 + jitter(3), 9).alias("lon"))
