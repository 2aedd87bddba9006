"""Stamps, tags and checks of graph nodes and pages; list files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, pages
from ..operators import upsert
from ..sources import feeds
from ..sources.views import signals, table, with_
from ..workspace import Workspace
from .registry import query


@query("provenance_stamps", """WITH k AS (SELECT *, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 7 = 1 THEN ' nation' || s_nationkey || ' ' ELSE 'nation' || (s_nationkey + s_suppkey % 3 * 10) END AS source FROM supplier),
t AS (SELECT *, trim(coalesce(source, '')) AS key FROM k WHERE s_suppkey % 11 <> 0),
s AS (SELECT 'nation' || n_nationkey AS key, CASE WHEN n_nationkey % 4 = 0 THEN 'nation' || n_nationkey ELSE n_name END AS label, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'https://x/' || n_nationkey END AS url FROM nation WHERE n_nationkey < 15),
m AS (SELECT 'nation' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'estimation method: nation' || n_nationkey ELSE n_name END AS label, '' AS url FROM nation WHERE n_nationkey >= 12)
SELECT s_name AS name, t.key AS prov_source_key, coalesce(s.label, m.label, t.key) AS prov_source_label, coalesce(s.url, m.url, '') AS prov_source_url, CASE WHEN s_suppkey % 2 = 0 THEN 'real' ELSE '' END AS prov_tier, CAST(s_nationkey AS VARCHAR) AS prov_as_of, '' AS prov_notes
FROM t LEFT JOIN s ON s.key = t.key LEFT JOIN m ON m.key = t.key""")
def provenance_stamps(spark, sf_dir):
    """Facts of suppliers stamped with label and url of their source; estimates by their method."""
    k = F.col("s_suppkey")
    source = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, F.concat(F.lit(" nation"), "s_nationkey", F.lit(" "))).otherwise(F.concat(F.lit("nation"), F.col("s_nationkey") + k % 3 * 10))
    nodes = table(spark, sf_dir, "supplier").select(F.when(k % 11 != 0, F.col("s_name")).alias("name"), source.alias("source"), F.when(k % 2 == 0, " real").alias("tier"), F.col("s_nationkey").alias("as_of"), F.lit(None).cast("string").alias("notes"))
    n = table(spark, sf_dir, "nation").withColumn("key", F.concat(F.lit("nation"), "n_nationkey"))
    sources = n.where("n_nationkey < 15").select("key", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("label"), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("https://x/"), "n_nationkey")).alias("url"))
    methods = n.where("n_nationkey >= 12").select("key", F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.col("n_name")).alias("label"), F.lit(None).cast("string").alias("url"))
    return upsert.stamped(nodes, sources, methods)


@query("edge_upsert", """WITH e AS (SELECT DISTINCT s_suppkey AS src, s_nationkey AS dst FROM supplier),
u AS (SELECT src, dst, 10 AS volume, CASE WHEN src % 2 = 0 THEN 0.5::DOUBLE END AS cost FROM e WHERE src % 3 <> 0)
SELECT 's' || src AS src_id, 'n' || dst AS dst_id, 'EXPORTS' AS type, CASE WHEN src % 3 = 0 THEN 1 WHEN src % 5 = 0 THEN 20 ELSE 10 END AS volume, CASE WHEN src % 3 <> 0 AND src % 2 = 0 THEN 0.5::DOUBLE ELSE 9::DOUBLE END AS cost FROM e""")
def edge_upsert(spark, sf_dir):
    """Weights for edges whose ends are given by name or by id; a later value wins, a null one doesn't."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    sid, nid = F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "n_nationkey")
    nodes = s.select(sid.alias("id"), F.col("s_name").alias("name")).unionByName(n.select(nid.alias("id"), F.col("n_name").alias("name")))
    both = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    edges = both.select(sid.alias("src_id"), nid.alias("dst_id"), F.lit("EXPORTS").alias("type"), F.lit(1).alias("volume"), F.lit(9.0).alias("cost"))
    k = F.col("s_suppkey")
    given = both.where(k % 3 != 0).select(F.when(k % 2 == 0, sid).otherwise(F.col("s_name")).alias("src"), F.when(k % 4 < 2, nid).otherwise(F.col("n_name")).alias("dst"), F.lit("EXPORTS").alias("type"), F.lit(1).alias("seq"), F.lit(10).alias("volume"), F.when(k % 2 == 0, 0.5).alias("cost"), "s_suppkey")
    later = given.where(k % 5 == 0).withColumn("seq", F.lit(2)).withColumn("volume", F.lit(20)).withColumn("cost", F.lit(None).cast("double"))
    other = given.withColumn("type", F.lit("IMPORTS")).withColumn("volume", F.lit(77))
    return upsert.edge_attributes(edges, nodes, given.unionByName(later).unionByName(other).drop("s_suppkey"), ["volume", "cost"])


@query("page_tags", """WITH d AS (SELECT doc_id, ['Crude Grade', 'Port/Terminal', 'Country', ''][doc_id % 4 + 1] AS kind, CASE WHEN n_chars >= 4000 THEN 'critical' WHEN n_chars >= 2000 THEN 'Elevated' WHEN n_chars >= 1000 THEN '' END AS band FROM documents)
SELECT doc_id, 'tideline/' || ['crudegrade', 'portterminal', 'country', 'unknown'][doc_id % 4 + 1] || ' risk/' || coalesce(nullif(lower(band), ''), 'calm') AS tags, 'tideline/' || ['crudegrade', 'portterminal', 'country', 'unknown'][doc_id % 4 + 1] || ' own risk/action' AS retagged FROM d""")
def page_tags(spark, sf_dir):
    """Colour tags of pages, and the same after the band has changed; a tag of someone's own stays."""
    n = F.col("n_chars")
    band = F.when(n >= 4000, "critical").when(n >= 2000, "Elevated").when(n >= 1000, "")
    kind = F.get(F.array(*map(F.lit, ("Crude Grade", "Port/Terminal", "Country", ""))), (F.col("doc_id") % 4).cast("int"))
    t = pages.tags(kind, band)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(t, " ").alias("tags"), F.array_join(pages.retagged(F.array_append(t, F.lit("own")), F.lit("ACTION")), " ").alias("retagged"))


@query("first_label", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Entity' WHEN 1 THEN 'R' || n_regionkey ELSE 'Country' END AS label FROM nation")
def first_label(spark, sf_dir):
    k, e = F.col("n_nationkey") % 3, F.lit("Entity")
    labels = F.when(k == 0, F.array(e, e)).when(k == 1, F.array(e, F.concat(F.lit("R"), "n_regionkey"), F.lit("Country"))).otherwise(F.array(F.lit("Country"), e))
    return table(spark, sf_dir, "nation").select("n_nationkey", pages.first_label(labels).alias("label"))


@query("replay_filter", with_("sig") + " SELECT event_id, source FROM sig WHERE k % 5 IN (1, 2)")
def replay_filter(spark, sf_dir):
    """While a replay runs, only its own signals pass: their reference says so."""
    k = F.col("k") % 5
    ref = F.when(k.isin(1, 2), F.concat(F.lit("REPLAY:tick/"), "event_id")).when(k == 3, F.concat(F.lit("live REPLAY:"), "event_id")).when(k == 4, "")
    return signals(spark, sf_dir).withColumn("raw_ref", ref).where(pages.is_replay(F.col("raw_ref"))).select("event_id", "source")


@query("feed_rules", "SELECT doc_id, left(text, 60) AS headline FROM documents WHERE doc_id % 6 NOT IN (1, 2) AND doc_id % 10 <> 3 AND doc_id % 10 <> 7 AND text IS NOT NULL")
def feed_rules(spark, sf_dir):
    """A feed without own texts, assessments and raw event records."""
    k, i = F.col("doc_id") % 10, F.col("doc_id") % 6
    content = F.when(k == 3, F.concat(F.lit("The Risk Level IS assessed as high. "), "text")).otherwise(F.col("text"))
    head = F.when(k == 7, F.concat(F.when(i < 3, "GDELT: ").otherwise("x Goldstein=-4 "), F.left("text", F.lit(60)))).otherwise(F.left("text", F.lit(60)))
    d = table(spark, sf_dir, "documents").withColumn("origin", F.when(i == 1, "text").when(i == 2, "synthesis").otherwise(F.col("source"))).withColumn("content", content).withColumn("headline", head)
    return d.where(pages.in_feed(F.col("origin"), F.col("content"), F.col("headline"))).select("doc_id", "headline")


@query("front_matter", """WITH x AS (SELECT n_nationkey, n_nationkey % 8 AS k FROM nation)
SELECT n_nationkey, CASE k WHEN 0 THEN '' WHEN 1 THEN 'Missing YAML frontmatter block' WHEN 2 THEN 'Malformed frontmatter YAML' WHEN 3 THEN 'Missing required frontmatter field: ''risk_band''|Missing required frontmatter field: ''valid_at'''
 WHEN 4 THEN 'Missing factor sub-field: ''factors.gdelt''|Missing factor sub-field: ''factors.sanctions''' WHEN 5 THEN '''factors'' must be a dict with keys: ais, gdelt, price, sanctions' WHEN 6 THEN 'Missing required frontmatter field: ''factors''' ELSE '' END AS errors FROM x""")
def front_matter(spark, sf_dir):
    """Pages of a registry with and without faults in their front matter."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 8
    line = lambda name, value, where=F.lit(True): F.when(where, F.concat(F.lit(f"{name}: "), value, F.lit("\n"))).otherwise("")
    factors = F.when(k == 5, "factors: 3\n").when(k == 6, "").when(k == 4, "factors:\n  ais: 0.1\n  price: 0.2\n").otherwise("factors:\n  ais: 0.1\n  gdelt: 0.2\n  price: 0.3\n  sanctions: 0.4\n")
    body = F.concat(line("entity_id", F.concat(F.lit("n"), "n_nationkey")), line("entity_type", F.lit("Country")), line("risk_score", F.lit("0.2")), line("risk_band", F.lit("calm"), k != 3), factors, line("last_updated", F.lit("2024-01-01")), line("valid_at", F.lit("2024-01-01"), k != 3))
    text = F.when(k == 1, F.lit("# no block\n---\n")).when(k == 2, F.concat(F.lit("---\n"), body)).otherwise(F.concat(F.lit("---\n"), body, F.lit("---\nrisk_band: in the body [[x]]\n")))
    return n.select("n_nationkey", F.array_join(pages.front_matter_errors(text), "|").alias("errors"))


@query("money_text", "SELECT o_orderkey, format('${:,.0f}', o_totalprice) AS money, format('{:.1f}%', o_totalprice / 600000 * 100) AS percent FROM orders")
def money_text(spark, sf_dir):
    p = F.col("o_totalprice").cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.money(p).alias("money"), ids.percent(p / 600000).alias("percent"))


@query("hash_vectors", """WITH h AS (SELECT doc_id, sha256(encode(coalesce(text, ''))) AS a FROM documents), r AS (SELECT doc_id, a || sha256(unhex(a)) AS raw FROM h),
v AS (SELECT doc_id, list_transform(range(0, 16), lambda i: ('0x' || substr(raw, CAST(i * 8 + 1 AS INTEGER), 8))::BIGINT / 4294967296::DOUBLE * 2 - 1) AS v FROM r)
SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) AS first, round(v[16] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) AS last FROM v""")
def hash_vectors(spark, sf_dir):
    """Unit vectors that depend on the text alone."""
    d = table(spark, sf_dir, "documents").select("doc_id", ids.hash_embedding(F.col("text"), 16).alias("v"))
    return d.select("doc_id", F.round(F.col("v")[0], 9).alias("first"), F.round(F.col("v")[15], 9).alias("last"))


# ---- list files -------------------------------------------------------------------------


@query("csv_entries", """SELECT 'e' || s_suppkey AS uid, s_name AS name, ['person', 'vessel', 'entity', 'entity'][s_suppkey % 4 + 1] AS kind, CASE WHEN s_suppkey % 4 = 1 THEN lpad(CAST(s_suppkey AS VARCHAR), 9, '2') END AS mmsi, CASE WHEN s_suppkey % 4 = 1 THEN lpad(CAST(s_suppkey AS VARCHAR), 7, '9') END AS imo, 'P' || s_nationkey AS program, 'a "b", c' || chr(10) || 'd' || CASE WHEN s_suppkey % 2 = 0 THEN ' nation ' || s_nationkey ELSE '' END AS remarks FROM supplier WHERE s_suppkey % 9 <> 0""")
def csv_entries(spark, sf_dir):
    """A list in CSV, with quotes and line breaks in its fields, as entries."""
    k = F.col("s_suppkey")
    path = Workspace(spark, "csv-list").path
    text = F.col("s_suppkey").cast("string")
    numbers = F.when(k % 4 == 1, F.concat(F.lit("IMO "), F.lpad(text, 7, "9"), F.lit("; MMSI"), F.lpad(text, 9, "2")))
    table(spark, sf_dir, "supplier").select(F.concat(F.lit("e"), "s_suppkey").alias("id"), F.get(F.array(*map(F.lit, ("Person", "Vessel", "Company", "LegalEntity"))), (k % 4).cast("int")).alias("schema"), F.when(k % 9 != 0, F.col("s_name")).otherwise("  ").alias("name"), F.lit('a "b", c\nd').alias("aliases"), F.when(k % 2 == 0, F.concat(F.lit("nation "), "s_nationkey")).alias("countries"), F.lit(None).cast("string").alias("addresses"), numbers.alias("identifiers"), F.lit("").alias("sanctions"), F.concat(F.lit("P"), "s_nationkey").alias("program_ids")).write.option("escape", '"').csv(path, header=True)
    return feeds.read_sanctions(spark, path, "csv")


@query("un_entries", "SELECT s_suppkey AS uid, CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' of ' || s_nationkey ELSE s_name END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'person' ELSE 'entity' END AS kind, 'L' || s_nationkey AS program FROM supplier")
def un_entries(spark, sf_dir):
    """A list in XML with two kinds of rows, whose names are in parts."""
    path = Workspace(spark, "xml-list").path
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("DATAID"), F.col("s_name").alias("FIRST_NAME"), F.when(F.col("s_suppkey") % 3 == 0, "of").alias("SECOND_NAME"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey").cast("string")).alias("THIRD_NAME"), F.concat(F.lit("L"), "s_nationkey").alias("UN_LIST_TYPE"))
    for tag, rest in (("INDIVIDUAL", 0), ("ENTITY", 1)):
        s.where(F.col("DATAID") % 2 == rest).write.format("xml").option("rootTag", f"{tag}S").option("rowTag", tag).mode("append").save(path)
    return feeds.read_sanctions(spark, path, "un")


@query("tick_files", with_("sig") + """ SELECT strftime(ts, '%Y-%m-%d') AS date, 'crisis' || (entity % 3) AS crisis_name, bool_or(severity > 0.9) AS within_24h_of_crossing, round(max(tone), 6) AS tone, count(*) AS events FROM sig GROUP BY 1, 2""")
def tick_files(spark, sf_dir):
    """Labelled ticks in JSON arrays, one for each crisis and day, read back with their features as columns."""
    path = Workspace(spark, "ticks").path
    t = signals(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.lit("crisis"), F.col("entity") % 3).alias("crisis_name")).agg(F.bool_or(F.col("severity") > 0.9).alias("within_24h_of_crossing"), F.struct(F.round(F.max("tone"), 6).alias("tone"), F.count("*").alias("events")).alias("features"))
    t.select(F.concat(F.lit("[\n"), F.to_json(F.struct("*")), F.lit("\n]")).alias("value"), "crisis_name", "date").write.partitionBy("crisis_name", "date").text(path)
    return feeds.read_ticks(spark, f"{path}/*/*/*.txt")


