"""Streams with memory as queries: the rows land in two runs of one checkpoint, so each query also stops and goes on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FIRE_COOLDOWN_S, INGEST_IMMEDIATE, PENDING_TTL_H
from ..functions.scores import band_rank
from ..sources import feeds
from ..sources.views import signals, table, with_
from ..streaming import commits, jobs, stateful
from ..workspace import Workspace
from .intelligence import _PING, pings
from .io import Kept
from .registry import SQL, query
from .risk import BATCH_SQL, batch_scores

#: Where the second run begins.
MID = "timestamp'2024-01-15'"
#: Milliseconds that watermarks lag behind.
LATE_MS = 600_000


def landing(spark: SparkSession, name: str, rows: DataFrame, ts: str) -> Iterator[DataFrame]:
    """The stream after the rows before MID have landed and again after those from MID on have."""
    src = Workspace(spark, f"{name}-in").path
    for part in (rows.where(F.col(ts) < F.expr(MID)), rows.where(F.col(ts) >= F.expr(MID))):
        part.write.mode("append").parquet(src)
        yield spark.readStream.schema(rows.schema).parquet(src)


def in_two_runs(spark: SparkSession, name: str, rows: DataFrame, ts: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the job makes of the rows before MID and, started again, of those after it."""
    out = Kept(spark, name)
    for stream in landing(spark, name, rows, ts):
        out.run(job(stream))
    return out.read()


def passed_in_two_runs(spark: SparkSession, name: str, rows: DataFrame, ts: str, effect: Callable[[str], commits.Ordered]) -> commits.Ordered:
    """The effect, made for a folder, after the rows of both runs that the watermark passed."""
    path = Workspace(spark, name).path
    for stream in landing(spark, name, rows, ts):
        done = effect(path)
        jobs.run_available(stateful.passed(stream, ts), done, f"{path}/checkpoint").awaitTermination()
    return done


def _mark(rows: str, ts: str = "ts") -> str:
    return f"seen AS (SELECT * FROM {rows} WHERE epoch_us({ts}) <= (SELECT epoch_ms(max({ts})) - {LATE_MS} FROM {rows}) * 1000)"


@query("stream_vessels", with_("sig") + f""", {_PING}, {_mark('ping')},
d AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY vessel ORDER BY ts, event_id)) / 3.6e9 AS since FROM seen),
e AS (SELECT *, count(*) FILTER (since > 24) OVER (PARTITION BY vessel ORDER BY ts, event_id) AS life, CASE WHEN since <= 24 THEN since END AS gap_h FROM d),
g AS (SELECT *, CASE WHEN count(speed) OVER (w ROWS 49 PRECEDING) >= 3 THEN stddev_pop(speed) OVER (w ROWS 49 PRECEDING) END AS speed_std FROM e WINDOW w AS (PARTITION BY vessel, life ORDER BY ts, event_id))
SELECT event_id, round(gap_h, 6) AS gap_h, round(speed_std, 6) AS speed_std, round(0.45::DOUBLE * least(coalesce(gap_h, 0) / 24, 1) + 0.30::DOUBLE * least(coalesce(speed_std, 0) / 5, 1) + CASE WHEN monitored THEN 0.25::DOUBLE ELSE 0 END, 6) AS score,
  coalesce(gap_h, 0) >= 4 AND monitored AS dark, gap_h IS NOT NULL AS known FROM g""")  # fmt: skip
def stream_vessels(spark, sf_dir):
    """Each vessel's last position and speeds are state; a silence of over 24 hours prunes it, and it comes back as a new one."""
    got = passed_in_two_runs(spark, "vessels", pings(spark, sf_dir), "ts", lambda path: commits.Tracks(spark, path)).out.read()
    return got.select("event_id", F.round("gap_h", 6).alias("gap_h"), F.round("speed_std", 6).alias("speed_std"), "score", "dark", "known")


@query("stream_pending", BATCH_SQL + f""",
{_mark('scored', 'observed_at')},
c AS (SELECT entity, observed_at, band, lag(band) OVER (PARTITION BY entity ORDER BY observed_at, flush) AS was FROM seen),
o AS (SELECT entity, observed_at AS opened_at, (SELECT min(observed_at) FROM c h WHERE h.entity = c.entity AND h.band IN ('action', 'critical') AND h.observed_at > c.observed_at AND h.observed_at <= c.observed_at + INTERVAL {PENDING_TTL_H} HOUR) AS hit FROM c WHERE band = 'elevated' AND coalesce(was, 'calm') IN ('calm', 'watch'))
SELECT entity, opened_at, CASE WHEN hit IS NULL THEN 'expired' ELSE 'promoted' END AS outcome, coalesce(hit, opened_at + INTERVAL {PENDING_TTL_H} HOUR) AS at FROM o
WHERE hit IS NOT NULL OR epoch_us(opened_at + INTERVAL {PENDING_TTL_H} HOUR) <= (SELECT epoch_ms(max(observed_at)) - {LATE_MS} FROM scored) * 1000""")  # fmt: skip
def stream_pending(spark, sf_dir):
    """Scenarios that wait for a crossing: the next one promotes them, or their event-time timer lets them expire."""
    s = batch_scores(spark, sf_dir).select("entity", "observed_at", "flush", "band")
    got = in_two_runs(spark, "pending", s, "observed_at", stateful.pending)
    return got.select("entity", F.timestamp_micros("opened_us").cast("timestamp_ntz").alias("opened_at"), "outcome", F.timestamp_micros("at_us").cast("timestamp_ntz").alias("at"))


@query("stream_flushes", with_("sig") + f""", {_mark('sig')},
r AS (SELECT event_id, ts, unnest(list_distinct([CAST(user_id % 25 AS INTEGER), CAST(k % 25 AS INTEGER), CAST(user_id % 7 AS INTEGER)])) AS entity FROM seen),
n AS (SELECT *, (row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) - 1) // 10 AS flush FROM r)
SELECT entity, CAST(flush AS BIGINT) AS flush, string_agg(event_id, ',' ORDER BY ts, event_id) AS ids, max(ts) AS observed_at FROM n GROUP BY entity, flush HAVING count(*) = 10""")  # fmt: skip
def stream_flushes(spark, sf_dir):
    """Signals that name up to three entities each, counted under every one of them; ten make a batch."""
    refs = F.array((F.col("user_id") % 25).cast("int"), (F.col("k") % 25).cast("int"), (F.col("user_id") % 7).cast("int"))
    s = signals(spark, sf_dir).select("event_id", "ts", refs.alias("entity_refs"))
    got = passed_in_two_runs(spark, "flushes", s, "ts", lambda path: commits.Flushes(spark, path)).flushes()
    return got.select("entity", "flush", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"), F.col("observed_at").cast("timestamp_ntz").alias("observed_at"))


@query("stream_deferred", with_("sig") + f""",
news AS (SELECT entity, event_id, ts, source, k = 99 AS force, CASE WHEN severity > 0.7 THEN 'HIGH' WHEN severity > 0.35 THEN 'MED' ELSE 'LOW' END AS priority, 'user ' || user_id || ' at ' || k AS summary, value / 500 AS score FROM sig WHERE source IN ('news', 'gdelt')),
{_mark('news')},
d AS (SELECT *, date_trunc('day', ts + INTERVAL 10 MINUTE) + INTERVAL 1 DAY - INTERVAL 10 MINUTE AS closes FROM seen),
b AS (SELECT *, count(*) FILTER (score >= {INGEST_IMMEDIATE}) OVER (PARTITION BY entity, closes ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY entity, closes, part ORDER BY NOT force, list_position(['HIGH', 'MED', 'LOW'], priority), ts, event_id) AS rn FROM b),
g AS (SELECT entity, closes, part, bool_or(score >= {INGEST_IMMEDIATE}) AS early, CASE WHEN bool_or(score >= {INGEST_IMMEDIATE}) THEN max(ts) ELSE closes END AS closed_at, arg_min(event_id, rn) AS anchor, count(*) AS n,
  arg_min(summary, rn) || CASE WHEN count(*) > 1 THEN chr(10) || chr(10) || 'Additional signals accumulated since last synthesis (' || (count(*) - 1) || ' more):' || chr(10)
    || string_agg('• [' || upper(source) || ' ' || strftime(ts, '%Y-%m-%d') || '] ' || summary, chr(10) ORDER BY rn) FILTER (rn BETWEEN 2 AND 21) ELSE '' END AS text FROM o GROUP BY entity, closes, part)
SELECT entity, closed_at, early, anchor, n, text FROM g WHERE early OR epoch_us(closes) <= (SELECT epoch_ms(max(ts)) - {LATE_MS} FROM news) * 1000""")  # fmt: skip
def stream_deferred(spark, sf_dir):
    """News gather under their entity until 23:50, or until a score of 0.8; each batch becomes one text of an anchor and 20 others."""
    priority = F.when(F.col("severity") > 0.7, "HIGH").when(F.col("severity") > 0.35, "MED").otherwise("LOW")
    s = signals(spark, sf_dir).where("source in ('news', 'gdelt')").select("entity", "event_id", "ts", "source", priority.alias("priority"), (F.col("k") == 99).alias("force"), F.concat(F.lit("user "), "user_id", F.lit(" at "), "k").alias("summary"), (F.col("value") / 500).alias("score"))
    got = in_two_runs(spark, "deferred", s, "ts", stateful.deferred)
    return got.select("entity", F.timestamp_micros("closed_us").cast("timestamp_ntz").alias("closed_at"), "early", "anchor", "n", "text")


def _states(spark, sf_dir) -> DataFrame:
    return batch_scores(spark, sf_dir).select("entity", F.col("observed_at").alias("ts"), F.col("flush").alias("event_id"), band_rank(F.col("band")).alias("rank"), "score")


@query("stream_crossings", SQL["band_crossings"])
def stream_crossings(spark, sf_dir):
    """Band crossings of states that arrive as a stream: the last band fired and its time are state, a restart in between changes nothing."""
    got = in_two_runs(spark, "crossings", _states(spark, sf_dir), "ts", lambda s: jobs.crossings(s, FIRE_COOLDOWN_S))
    return got.select("entity", (F.col("event_id") + 1).alias("n"), "rank")


@query("stream_decay", SQL["risk_decay_max"].replace("flush, score, round", "flush, round"))
def stream_decay(spark, sf_dir):
    """The running score of each entity as state."""
    got = in_two_runs(spark, "decay", _states(spark, sf_dir), "ts", jobs.decayed)
    return got.select("entity", F.col("event_id").alias("flush"), F.round("decayed", 9).alias("decayed"))


# ---- effects of micro-batches -----------------------------------------------------------


def batches(spark: SparkSession, name: str, parts: list[DataFrame], effect: Callable[[DataFrame, int], None], again: bool = True) -> None:
    """The parts land one after the other, each with a start of the stream of its own; ``again`` repeats the last batch, as Spark does after a loss."""
    w = Workspace(spark, name)
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(f"{w.path}/in")
        jobs.run_available(spark.readStream.schema(part.schema).parquet(f"{w.path}/in"), effect, f"{w.path}/checkpoint").awaitTermination()
        if again:
            effect(part, i)


@query("stream_list_changes", """WITH l AS (SELECT p.poll, c_custkey AS uid, c_name AS name FROM customer, range(1, 5) p(poll) WHERE (c_custkey + p.poll) % 5 <> 0)
SELECT CAST(poll AS INTEGER) AS poll, uid, name, 'add' AS change FROM l n WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.uid = n.uid AND o.poll = n.poll - 1)
UNION ALL SELECT CAST(poll + 1 AS INTEGER), uid, name, 'remove' FROM l o WHERE poll < 4 AND NOT EXISTS (SELECT 1 FROM l n WHERE n.uid = o.uid AND n.poll = o.poll + 1)""")
def stream_list_changes(spark, sf_dir):
    """A list polled four times in two runs; the first poll adds everything, and a batch that runs twice changes nothing."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("poll")).where("(uid + poll) % 5 <> 0")
    effect = commits.ListChanges(spark, Workspace(spark, "list").path, ["uid", "name"])
    batches(spark, "list-in", [c.where("poll <= 2"), c.where("poll > 2")], effect)
    return effect.changes.read().select("poll", "uid", "name", "change")


@query("stream_retrain", "SELECT 'calibrate_fusion' AS job, CAST(50 * i AS BIGINT) AS count FROM range(1, (SELECT count(*) // 50 + 1 FROM orders)) r(i)")
def stream_retrain(spark, sf_dir):
    """A retrain job each time the ledger passes another 50 rows, once, also over a restart and a repeated batch."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    effect = commits.CountTrigger(spark, Workspace(spark, "retrain").path)
    batches(spark, "retrain-in", [o.where(F.col("o_orderkey") % 3 == r) for r in range(3)], effect)
    return effect.jobs.read().select("job", "count")


_EPISODES = BATCH_SQL + """,
w AS (SELECT *, CAST(entity AS VARCHAR) || '-' || CAST(flush AS BIGINT) AS signal_id, CASE WHEN flush % 4 = 3 THEN '' ELSE '# ' || entity || chr(10) || band END AS text FROM scored)"""


@query("stream_pages", _EPISODES + """
SELECT 'graph' AS step, 'fusion_' || signal_id AS key, text AS value FROM w
UNION ALL SELECT 'page', CAST(entity AS VARCHAR), arg_max(text, (observed_at, signal_id)) FROM w WHERE text <> '' GROUP BY entity
UNION ALL SELECT 'event', type, CAST(count(*) AS VARCHAR) FROM (SELECT unnest(CASE WHEN band IN ('action', 'critical') THEN ['threshold', 'pipeline_stage', 'agent_trace', 'scenario.promoted'] ELSE ['threshold', 'pipeline_stage', 'agent_trace'] END) AS type FROM w) GROUP BY type""")
def stream_pages(spark, sf_dir):
    """Episodes of the graph, then pages that are valid, then events, in two runs with repeated batches."""
    s = batch_scores(spark, sf_dir).select("entity", "score", "band", "observed_at", F.concat_ws("-", "entity", "flush").alias("signal_id"), F.lit("fusion").alias("source"), F.when(F.col("flush") % 4 == 3, "").otherwise(F.concat(F.lit("# "), "entity", F.lit("\n"), "band")).alias("text"))
    effect = commits.GatedPages(spark, Workspace(spark, "pages").path, F.length("text") > 0)
    batches(spark, "pages-in", [s.where(F.col("observed_at") < F.expr(MID)), s.where(F.col("observed_at") >= F.expr(MID))], effect)
    graph = effect.graph.read().select(F.lit("graph").alias("step"), F.col("name").alias("key"), F.col("text").alias("value"))
    pages = effect.current().select(F.lit("page").alias("step"), F.col("entity").cast("string").alias("key"), F.col("text").alias("value"))
    told = effect.events.read().groupBy(F.get_json_object("event", "$.type").alias("key")).agg(F.count("*").cast("string").alias("value")).select(F.lit("event").alias("step"), "key", "value")
    return graph.unionByName(pages).unionByName(told)


# ---- a polled source --------------------------------------------------------------------

#: Keywords of the provider; three are asked in a poll.
KEYWORDS = [f"k{i}" for i in range(13)]


@query("stream_polled", """WITH i AS (SELECT doc_id, doc_id % 13 AS k, doc_id // 13 % 20 AS shown FROM documents)
SELECT 'd' || doc_id AS id, 'k' || k AS keyword, shown FROM i WHERE EXISTS (SELECT 1 FROM range(0, 22) p(p) WHERE p.p >= i.shown AND (i.k - 3 * p.p % 13 + 13) % 13 < 3)""")
def stream_polled(spark, sf_dir):
    """A provider asked for 3 of 13 keywords a poll, in two runs of 9 and 13 polls: items shown again come once, and none is lost."""
    spark.dataSource.register(feeds.PolledStream)
    src = Workspace(spark, "provider").path
    shown = F.floor(F.col("doc_id") / 13) % 20
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("k"), F.col("doc_id") % 13).alias("keyword"), shown.cast("int").alias("shown"), F.concat(F.lit("d"), "doc_id").alias("id"), F.left("text", F.lit(80)).alias("title"), F.col("text").alias("body"), F.timestamp_seconds(1704067200 + 900 * shown).alias("published"))
    d.write.partitionBy("keyword").option("parquet.block.size", 8 << 20).parquet(src)
    out = Kept(spark, "polled")
    for polls in (9, 22):
        items = spark.readStream.format("polled_stream").option("provider", "tideline.sources.feeds:stored_pages").option("keywords", ",".join(KEYWORDS)).option("polls", str(polls)).option("path", src.removeprefix("file:") if src.startswith("file:") else src).load()
        # an item is seen five polls after it is shown at the latest, so a watermark of two hours loses none
        out.run(jobs.deduped(items, "id", "published", "2 hours"))
    return out.read().select("id", "keyword", ((F.unix_seconds("published") - 1704067200) / 900).cast("long").alias("shown"))
