"""Sources, sinks and streams as queries: the tables go out through a sink, come back through a source, and must be what they were."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.prose import prose
from ..operators import models, scenario
from ..sources import bundle, feeds, sinks
from ..sources.views import SIGNAL, signals, table, ticks, with_
from ..streaming import jobs
from ..workspace import Workspace
from .intelligence import _CP, _PING
from .registry import query


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the cluster names; it goes when the driver ends."""
    return Workspace(spark, name).path


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through the file system of its path."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


# ---- bundles ----------------------------------------------------------------------------


@query("bundle_load", """SELECT 'suppliers' AS part, CAST(s_suppkey AS VARCHAR) AS key, CAST(length(s_name) AS DOUBLE) AS value FROM supplier
UNION ALL SELECT 'routes', s_suppkey || '>' || s_nationkey, s_nationkey::DOUBLE FROM supplier
UNION ALL SELECT 'params', CASE WHEN n_nationkey % 3 = 0 THEN 'freight' || n_nationkey ELSE 'param|' || n_name END, n_nationkey * 2.5::DOUBLE FROM nation""")
def bundle_load(spark, sf_dir):
    """A bundle of two tables and parameters, found by its manifest; of a parameter given twice the last counts."""
    path = work_folder(spark, "bundle")
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("canonical_name"), F.lit("real").alias("tier"), F.lit("x").alias("source")).write.csv(f"{path}/suppliers.csv", header=True)
    s.select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("target_id"), F.col("s_nationkey").alias("weight")).write.csv(f"{path}/routes.csv", header=True)
    per = n.select(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("freight"), "n_nationkey")).otherwise("param").alias("param"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("ALL")).otherwise(F.col("n_name")).alias("country"), "n_nationkey")
    twice = per.select("*", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit(1.0).alias("f")), F.struct(F.lit(1).alias("o"), F.lit(2.5).alias("f")))).alias("x"))
    twice.select("param", "country", (F.col("n_nationkey") * F.col("x.f")).alias("value"), "x.o").coalesce(1).sortWithinPartitions("o").drop("o").write.csv(f"{path}/params.csv", header=True)
    put_text(spark, f"{path}/manifest.yaml", "name: x\ntables:\n  suppliers: suppliers.csv\n  routes: routes.csv\n  params: params.csv\n")
    t = bundle.load(spark, path)
    a = spark.table("ctx_suppliers").select(F.lit("suppliers").alias("part"), F.col("entity_id").alias("key"), F.length("canonical_name").cast("double").alias("value"))
    b = t["routes"].select(F.lit("routes").alias("part"), F.concat_ws(">", "src_entity_id", "dst_entity_id").alias("key"), F.col("weight").cast("double").alias("value"))
    return a.unionByName(b).unionByName(bundle.params(t["params"]).select(F.lit("params").alias("part"), "key", "value"))


@query("wiki_pages", "SELECT 'nation_' || n_nationkey AS entity_id, n_name AS title, '2024-01-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS updated, CASE WHEN n_nationkey % 2 = 0 THEN ['Region ' || n_regionkey, 'All'] ELSE ['Region ' || n_regionkey] END AS links FROM nation")
def wiki_pages(spark, sf_dir):
    """Markdown pages with front matter, one for each entry of a registry, which is a small fixed list."""
    path = work_folder(spark, "pages")
    for r in table(spark, sf_dir, "nation").collect():
        more = " [[All|every one]] and [[All]]" if r["n_nationkey"] % 2 == 0 else ""
        put_text(spark, f"{path}/nation_{r['n_nationkey']}.md", f"---\ntitle: {r['n_name']}\nupdated: 2024-01-{r['n_nationkey'] + 1:02d}\n---\nSee [[Region {r['n_regionkey']}]]{more}.\n")
    return bundle.pages(spark, path).select("entity_id", "title", "updated", F.col("links_out").alias("links"))


@query("settings_rows", "SELECT * FROM (VALUES ('REGION', 'Gulf'), ('MODE', 'local'), ('TOKEN', 'a=b'), ('LEVEL', '3'), ('EMPTY', '')) t(key, value)")
def settings_rows(spark, sf_dir):
    """Settings of two files, the first one's before the second's."""
    path = work_folder(spark, "settings")
    put_text(spark, f"{path}/local", "# own\nMODE=remote\nMODE='local'\n\nexport TOKEN = \"a=b\"\nno sign\n")
    put_text(spark, f"{path}/common", "MODE=shared\nREGION=Gulf\n  LEVEL= 3 \nEMPTY=\n")
    return bundle.settings(spark, f"{path}/local", f"{path}/common")


@query("matrix_rows", "SELECT a.r_name AS row, b.r_name AS \"column\", a.r_regionkey * 10.0::DOUBLE + b.r_regionkey AS value FROM region a, region b")
def matrix_rows(spark, sf_dir):
    """A square matrix in CSV, its columns in the order of the header."""
    path = work_folder(spark, "matrix")
    r = [(x["r_regionkey"], x["r_name"]) for x in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    put_text(spark, f"{path}/io.csv", ",".join(["sector", *(n for _, n in r)]) + "\n" + "".join(",".join([n, *(str(10 * k + j) for j, _ in r)]) + "\n" for k, n in r))
    return bundle.matrix(bundle.read_table(spark, f"{path}/io.csv"), "sector")




@query("prose_facts", """SELECT s_suppkey AS id, s_name || ' (Supplier) is based in country ' || n_name || ', has daily_export_mbpd of ' || (s_suppkey % 7) || ', and ' || CASE WHEN s_suppkey % 4 = 0 THEN 'is sanctioned' ELSE 'is not sanctioned' END || '.' AS node,
s_name || ' (Supplier) EXPORTS_VIA ' || n_name || ' (Corridor) at volume_mbpd ' || (s_suppkey % 5) || '.' AS edge FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def prose_facts(spark, sf_dir):
    """Rows of a registry told as sentences."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    s = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("canonical_name"), F.col("n_name").alias("country"), (F.col("s_suppkey") % 7).alias("daily_export_mbpd"), (F.col("s_suppkey") % 4 == 0).alias("sanctioned"), F.col("s_name").alias("src_name"), F.col("n_name").alias("dst_name"), (F.col("s_suppkey") % 5).alias("volume_mbpd"))
    return s.select("id", prose("Supplier").alias("node"), prose("EXPORTS_VIA").alias("edge"))


# ---- files in and out -------------------------------------------------------------------


@query("ledger_scan", "WITH l AS (SELECT 'o' || o_orderkey AS scenario_id, CAST(o_custkey % 9 AS VARCHAR) AS entity, o_totalprice / 100000 AS gap, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders) SELECT scenario_id, entity, gap FROM l QUALIFY row_number() OVER (PARTITION BY entity ORDER BY day || scenario_id DESC) <= 50")
def ledger_scan(spark, sf_dir):
    """A ledger appended to twice, with a blank and a broken line; the newest 50 of each entity."""
    path = work_folder(spark, "ledger")
    axes = ("gap_mbpd", "price_impact_high", "spr_depletion_days", "gdp_proxy_impact_pct")
    vector = F.struct(*[(F.col("o_totalprice") / 100000 if a == "gap_mbpd" else F.lit(None).cast("double")).alias(a) for a in axes])
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("scenario_id"), (F.col("o_custkey") % 9).cast("string").alias("entity"), vector.alias("predicted"), F.lit("x").alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("predicted_at"), "o_orderkey")
    for rest in (0, 1):
        sinks.append_jsonl(o.where(F.col("o_orderkey") % 2 == rest).drop("o_orderkey"), path)
    put_text(spark, f"{path}/by-hand.json", "\nbroken {\n\n")
    got = sinks.capped(feeds.read_ledger(spark, path).withColumn("at", F.concat("predicted_at", "scenario_id")), "entity", "at", 50)
    return got.select("scenario_id", "entity", F.col("predicted.gap_mbpd").alias("gap"))


_GDELT = "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS actor1, 'u' || user_id AS actor2, value AS goldstein, CAST(k - 50 AS DOUBLE) AS tone, 'http://x/' || event_id AS url FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def _gdelt(spark, sf_dir) -> str:
    path = work_folder(spark, "gdelt")
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    named = {0: F.col("event_id").cast("string"), 6: F.col("event_type"), 16: F.concat(F.lit("u"), "user_id"), 30: F.col("value").cast("string"), 34: (F.col("k") - 50).cast("string"), 57: F.concat(F.lit("http://x/"), "event_id")}
    e.select(*[named.get(i, F.lit("-")).alias(f"c{i}") for i in range(58)]).write.option("sep", "\t").csv(path)
    return path


@query("gdelt_scan", _GDELT)
def gdelt_scan(spark, sf_dir):
    return feeds.read_gdelt(spark, _gdelt(spark, sf_dir))


@query("gdelt_stream", _GDELT)
def gdelt_stream(spark, sf_dir):
    """The same files as a stream, kept by micro-batch."""
    out = Kept(spark, "gdelt")
    out.run(feeds.read_gdelt(spark, _gdelt(spark, sf_dir), stream=True))
    return out.read()


@query("polled_news", "SELECT k AS keyword, k || '-' || i AS id, 'Title of ' || k AS title, 'Body ' || i AS body, TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS published FROM (VALUES ('oil'), ('strait'), ('tanker')) v(k), range(0, 3) r(i)")
def polled_news(spark, sf_dir):
    """A provider asked for pages, a keyword to a partition."""
    spark.dataSource.register(feeds.PolledSource)
    got = spark.read.format("polled").option("provider", "tideline.sources.feeds:sample_pages").option("keywords", "oil,strait,tanker").load()
    return got.withColumn("published", F.col("published").cast("timestamp_ntz"))


@query("snapshots", "SELECT 'first' AS version, n_nationkey AS id FROM nation UNION ALL SELECT 'newest', n_nationkey FROM nation WHERE n_nationkey < 10")
def snapshots(spark, sf_dir):
    """A table in versions: the first is still there after the second, which is what readers see."""
    path, n = work_folder(spark, "versions"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    first = sinks.write_version(n, path)
    sinks.write_version(n.where("id < 10"), path)
    return sinks.read_version(spark, path, first).select(F.lit("first").alias("version"), "id").unionByName(sinks.read_version(spark, path).select(F.lit("newest").alias("version"), "id"))


@query("deferred_unexpired", with_("sig") + " SELECT event_id FROM sig WHERE source = 'news' AND ts + INTERVAL 36 HOUR > TIMESTAMP '2024-01-20'")
def deferred_unexpired(spark, sf_dir):
    s = signals(spark, sf_dir).where("source = 'news'").withColumn("expires_at", F.col("ts") + F.expr("interval 36 hours"))
    return sinks.unexpired(s, "2024-01-20").select("event_id")


@query("envelopes", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'broken' ELSE 'good' END AS kind, CAST(doc_id AS VARCHAR) AS id FROM documents")
def envelopes(spark, sf_dir):
    """Lines of JSON: envelopes, and broken lines beside them."""
    d = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.col("doc_id") % 1000 + 1704067200)
    full = F.to_json(F.struct(F.lit("1").alias("schema_version"), F.col("doc_id").cast("string").alias("signal_id"), F.lit("ais").alias("source"), F.lit("LOW").alias("priority_hint"), F.left("text", F.lit(40)).alias("summary"), at.alias("observed_at"), at.alias("ingested_at"), F.lit(False).alias("force_synthesis"), F.array("lang").alias("entity_refs"), F.array("lang").alias("h3_cells"), F.create_map(F.lit("a"), F.lit("b")).alias("payload")))
    lines = d.select(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("{\"id\": "), "doc_id")).otherwise(full).alias("value"))
    good, bad = jobs.valid_envelopes(lines, SIGNAL)
    return good.select(F.lit("good").alias("kind"), F.col("signal_id").alias("id")).unionByName(bad.select(F.lit("broken").alias("kind"), F.regexp_extract("line", r"\d+", 0).alias("id")))


@query("name_ids", "SELECT n_name AS name, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', CAST((('0x' || substr(h, 17, 1))::BIGINT) % 4 AS INTEGER) + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS id FROM (SELECT n_name, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(n_name)) AS h FROM nation)")
def name_ids(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), ids.uuid5("n_name").alias("id"))


@query("model_artifact", "SELECT 's' || i AS scenario, TRUE AS same FROM range(0, 40) r(i) UNION ALL SELECT 'absent', TRUE")
def model_artifact(spark, sf_dir):
    """A model saved and loaded again answers alike; where none was saved there is none."""
    path = work_folder(spark, "model")
    data = scenario.summary(scenario.scenarios(spark, [{"scenario": f"s{i}", "fraction": i / 40, "bypass": 1 + i % 4} for i in range(40)])).select("scenario", "gap", "fraction")
    fitted = models.surrogate(data, ["fraction"], "gap", trees=3)
    models.save(fitted, path)
    both = models.predict(fitted, ["fraction"], data).select("scenario", F.col("gap_hat").alias("a")).join(models.predict(models.load(path), ["fraction"], data).select("scenario", F.col("gap_hat").alias("b")), "scenario")
    return both.select("scenario", (F.col("a") == F.col("b")).alias("same")).unionByName(spark.createDataFrame([("absent", models.load(path + "-none") is None)], "scenario string, same boolean"))


# ---- streams ----------------------------------------------------------------------------


class Kept:
    """A stream's results by micro-batch: a batch that runs again after a loss replaces itself."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, work_folder(spark, name)

    def run(self, stream: DataFrame, mode: str = "append") -> None:
        self.schema = stream.schema
        q = jobs.run_available(stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{self.path}/out/batch={i}"), f"{self.path}/checkpoint", mode)
        q.awaitTermination()

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/out").select(*self.schema.names)


@query("stream_changepoints", _CP + " SELECT event_id, round(coalesce(z, 0), 6) AS z FROM p")
def stream_changepoints(spark, sf_dir):
    """Ticks landing as files, in two runs from one checkpoint: each instrument's moments go on where they stopped."""
    t, out = ticks(spark, sf_dir), Kept(spark, "ticks")
    mid = F.expr("timestamp'2024-01-15'")
    for part in (t.where(F.col("ts") < mid), t.where(F.col("ts") >= mid)):
        part.write.mode("append").parquet(f"{out.path}/in")
        out.run(jobs.moments(spark.readStream.schema(t.schema).parquet(f"{out.path}/in")))
    return out.read().select("event_id", F.round("z", 6).alias("z"))


@query("stream_clusters", with_("sig") + f""", {_PING}, late AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM ping)
SELECT vessel % 12 AS cell, time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) FILTER (speed < 5) AS dark FROM ping GROUP BY 1, 2 HAVING time_bucket(INTERVAL 5 MINUTE, any_value(ts)) + INTERVAL 5 MINUTE <= (SELECT mark FROM late)""")
def stream_clusters(spark, sf_dir):
    """Positions as a stream with a watermark, stopped and started again; a window comes out once nothing can join it any more."""
    from .intelligence import pings

    p = pings(spark, sf_dir).select((F.col("vessel") % 12).alias("cell"), "ts", (F.col("speed") < 5).alias("dark"), F.lit(0.0).alias("gap_hours"), F.lit(0.0).alias("anomaly"))
    out, mid = Kept(spark, "clusters"), F.expr("timestamp'2024-01-15'")
    for part in (p.where(F.col("ts") < mid), p.where(F.col("ts") >= mid)):
        part.write.mode("append").parquet(f"{out.path}/in")
        out.run(jobs.clusters(spark.readStream.schema(p.schema).parquet(f"{out.path}/in")))
    return out.read().select("cell", F.col("window.start").cast("timestamp_ntz").alias("start"), "dark")
