from pyspark.sql import functions as F

from tideline.constants import FIRE_COOLDOWN_S
from tideline.functions.scores import band_rank
from tideline.operators import alerts, fusion
from tideline.operators.signals import changepoints
from tideline.sources.views import signals
from tideline.streaming import jobs


def landed(spark, sf_dir, path):
    """The signals of a few entities as two files, the earlier half first."""
    s = signals(spark, sf_dir).where("entity < 4").select(*[c.split()[0] for c in jobs.EVENT.split(", ")])
    mid = s.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    s.where(F.col("event_id") <= mid).coalesce(1).write.mode("append").parquet(path)
    s.where(F.col("event_id") > mid).coalesce(1).write.mode("append").parquet(path)
    return s


def run(df, tmp_path, name, mode="append"):
    rows = []
    q = jobs.run_available(df, lambda b, i: rows.extend(b.collect()), str(tmp_path / f"cp-{name}"), mode)
    assert q.awaitTermination(180)
    return rows


def test_windowed_scores(spark, sf_dir, tmp_path):
    s = landed(spark, sf_dir, str(tmp_path / "in"))
    got = {(r.entity, r.start): r.score for r in run(jobs.windowed_scores(jobs.read_signals(spark, str(tmp_path / "in"), 9), "24 hours", "12 hours"), tmp_path, "w")}
    want = fusion.fuse_consumer(fusion.features(s.withColumn("w", F.window("ts", "24 hours", "12 hours")), "entity", "w")).select("entity", F.col("w.start").alias("start"), "score").collect()
    want = {(r.entity, r.start): r.score for r in want}
    assert got and all(abs(want[k] - v) < 1e-9 for k, v in got.items())


def test_flushes(spark, sf_dir, tmp_path):
    s = landed(spark, sf_dir, str(tmp_path / "in"))
    got = run(jobs.flushes(jobs.read_signals(spark, str(tmp_path / "in"), 9)), tmp_path, "f")
    sizes = {r.entity: r["count"] for r in s.groupBy("entity").count().collect()}
    assert all(len(r.ids) == 10 for r in got)
    assert {e: sum(r.entity == e for r in got) for e in sizes} == {e: n // 10 for e, n in sizes.items()}


def test_crossings_equal_batch(spark, sf_dir, tmp_path):
    b = fusion.fuse_consumer(fusion.features(fusion.flushes(signals(spark, sf_dir)), "entity", "flush")).withColumn("rank", band_rank(F.col("band")))
    path = str(tmp_path / "scores")
    b.select("entity", F.col("observed_at").alias("ts"), F.col("flush").alias("event_id"), "rank", "score").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("entity int, ts timestamp, event_id long, rank int, score double").parquet(path)
    got = sorted((r.entity, r["rank"]) for r in run(jobs.crossings(stream), tmp_path, "c"))
    want = sorted((r.entity, r["rank"]) for r in alerts.crossings(b.withColumn("t", F.unix_micros("observed_at") / 1e6), FIRE_COOLDOWN_S).collect())
    assert got == want
    d = {(r.entity, r.event_id): r.decayed for r in run(jobs.decayed(stream), tmp_path, "d")}
    want = {(r.entity, r.flush): r.decayed for r in fusion.decayed(b).collect()}
    assert d.keys() == want.keys() and all(abs(d[k] - want[k]) < 1e-6 for k in d)


def test_moments_equal_windows(spark, sf_dir, tmp_path):
    from tideline.sources.views import ticks

    t = ticks(spark, sf_dir)
    t.coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("instrument int, event_id long, ts timestamp, price double").parquet(str(tmp_path / "t"))
    got = {r.event_id: r.z for r in run(jobs.moments(stream), tmp_path, "m")}
    want = {r.event_id: r.z or 0.0 for r in changepoints(t).collect()}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_dedup(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, s int").select("id", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema("id string, ts timestamp").parquet(str(tmp_path / "d"))
    assert len(run(jobs.deduped(stream, "id", "ts"), tmp_path, "d")) == 2
