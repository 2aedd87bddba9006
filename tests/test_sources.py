import json

from pyspark.sql import functions as F

from tideline.sources import bundle, feeds, sinks
from tideline.sources.views import SIGNAL
from tideline.streaming import jobs


def test_bundle(spark, tmp_path):
    (tmp_path / "manifest.yaml").write_text("name: x\ntables:\n  suppliers: s.csv\n  made_at: e.csv\n  params: p.csv\n")
    (tmp_path / "s.csv").write_text("entity_id,canonical_name,tier,source\na,Alpha,real,x\nb,Beta,guess,y\n,,,\n")
    (tmp_path / "e.csv").write_text("source_id,target_id,tier,source\na,b,derived,x\n")
    (tmp_path / "p.csv").write_text("param,country,value\nfreight,Iraq,1.5\nwar,ALL,0.8\nfreight,Iraq,1.7\n")
    t = bundle.load(spark, str(tmp_path))
    assert t["suppliers"].count() == 2 and t["made_at"].columns[:2] == ["src_entity_id", "dst_entity_id"]
    assert {r.key: r.value for r in bundle.params(t["params"]).collect()} == {"freight|Iraq": 1.7, "war": 0.8}
    bad = {(r.id, r.problem) for r in bundle.problems(t, spark.createDataFrame([("x",)], "source string")).collect()}
    assert bad == {("b", "tier"), ("b", "source")}


def test_pages_and_matrix(spark, tmp_path):
    (tmp_path / "alpha.md").write_text("---\ntitle: Alpha\nupdated: 2024-01-01\n---\nSee [[Beta|b]] and [[Gamma]].\n")
    r = bundle.pages(spark, str(tmp_path)).collect()[0]
    assert (r.entity_id, r.title, r.links_out) == ("alpha", "Alpha", ["Beta", "Gamma"])
    m = spark.createDataFrame([("a", "1", "2"), ("b", "3", "4")], "k string, a string, b string")
    assert sorted(map(tuple, bundle.matrix(m, "k").collect())) == [("a", "a", 1.0), ("a", "b", 2.0), ("b", "a", 3.0), ("b", "b", 4.0)]


def test_lists_ticks_ledgers(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<l><sdnEntry><uid>1</uid><firstName>A</firstName><lastName>B</lastName><sdnType>Individual</sdnType><program>P</program></sdnEntry></l>")
    assert feeds.read_sanctions(spark, str(tmp_path / "s.xml"), "xml").select("name", "kind").collect()[0] == ("A B", "person")
    (tmp_path / "u.xml").write_text("<l><INDIVIDUAL><DATAID>1</DATAID><FIRST_NAME>A</FIRST_NAME></INDIVIDUAL><ENTITY><DATAID>2</DATAID><FIRST_NAME>C</FIRST_NAME></ENTITY></l>")
    assert feeds.read_sanctions(spark, str(tmp_path / "u.xml"), "un").count() == 2
    (tmp_path / "t.json").write_text(json.dumps([{"date": "d", "crisis_name": "c", "within_24h_of_crossing": 1, "features": {"a": 1.0}}]))
    assert feeds.read_ticks(spark, str(tmp_path / "t.json")).collect()[0].a == 1.0
    (tmp_path / "l.jsonl").write_text('{"scenario_id": "x", "entity": "e"}\n\nbroken\n')
    assert feeds.read_ledger(spark, str(tmp_path / "l.jsonl")).count() == 1
    (tmp_path / "g.tsv").write_text("\t".join(str(i) for i in range(58)) + "\n")
    r = feeds.read_gdelt(spark, str(tmp_path / "g.tsv")).collect()[0]
    assert (r.id, r.actor1, r.goldstein, r.url) == ("0", "6", 30.0, "57")


def test_polled_source(spark):
    spark.dataSource.register(feeds.PolledSource)
    df = spark.read.format("polled").option("provider", "tests.provider:search").option("keywords", "a,b").load()
    assert sorted((r.keyword, r.id) for r in df.collect()) == [("a", "a1"), ("b", "b1")]


def test_versions_and_history(spark, tmp_path):
    path = str(tmp_path / "h")
    u = spark.createDataFrame([("a", 1, "2024-01-01"), ("b", 1, "2024-01-01")], "k string, v int, d string").withColumn("valid_at", F.to_timestamp("d")).drop("d")
    assert sinks.read_version(spark, path) is None
    sinks.upsert_history(u, path, "k")
    sinks.upsert_history(u.where("k = 'a'").withColumn("valid_at", F.expr("timestamp'2024-02-01'")).withColumn("v", F.lit(2)), path, "k")
    h = sinks.read_version(spark, path)
    assert h.count() == 3 and h.where("invalid_at is null").count() == 2 and sinks.read_version(spark, path, 1).count() == 2


def test_broken_envelopes(spark):
    ok = {"schema_version": "1", "signal_id": "s", "source": "ais", "priority_hint": "LOW", "summary": "", "observed_at": "2024-01-01T00:00:00Z", "ingested_at": "2024-01-01T00:00:00Z", "force_synthesis": False, "entity_refs": [], "h3_cells": [], "payload": {}}
    lines = spark.createDataFrame([(json.dumps(ok),), ("{nope",)], "value string")
    good, bad = jobs.valid_envelopes(lines, SIGNAL)
    assert good.count() == 1 and bad.collect()[0].line == "{nope"
