"""Effects of micro-batches that may run twice: what a batch leaves is a function of its rows and of the batches before it.

Spark repeats a micro-batch, under the same id, if it was lost before its end was recorded. So every effect is
written under the batch's id, a repeated batch overwrites itself, and what a batch reads of the past is the newest
finished state with a smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import FLUSH_SIZE
from ..operators import signals
from ..operators.fusion import numbered
from .stateful import VESSEL_TTL_H


class Ledger:
    """A table in parts by batch id; a part counts once its write is finished."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def ids(self) -> list[int]:
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        p = Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=") and fs.exists(Path(s.getPath(), "_SUCCESS")))

    def part(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/batch={batch_id}")

    def before(self, batch_id: int) -> DataFrame | None:
        """The newest part of an earlier batch."""
        past = [i for i in self.ids() if i < batch_id]
        return self.part(past[-1]) if past else None

    def read(self) -> DataFrame | None:
        """All finished parts, with their ``batch``."""
        have = self.ids()
        return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/batch={i}" for i in have]) if have else None


# ---- lists that are polled --------------------------------------------------------------


class ListChanges:
    """Changes between polls of whole lists, and the list as of the last poll.

    A batch has rows (poll, key columns); it may have several polls, in their order. The first poll of all adds
    everything. A poll without rows is one that failed and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.key, self.snapshots, self.changes = key, Ledger(spark, f"{path}/snapshot"), Ledger(spark, f"{path}/changes")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("poll", *self.key).distinct().persist()
        number = rows.select("poll").distinct().select("poll", F.row_number().over(Window.orderBy("poll")).alias("n"))  # a row a poll
        now = rows.join(number, "poll").select("n", *self.key)
        last = number.agg(F.max("n")).first()[0]
        if last is not None:
            old = self.snapshots.before(batch_id)
            if old is not None:
                now = now.unionByName(old.select(F.lit(0).alias("n"), *self.key))
            polls = F.broadcast(number)
            added = now.where("n > 0").join(now.withColumn("n", F.col("n") + 1), ["n", *self.key], "left_anti").withColumn("change", F.lit("add"))
            gone = now.where(F.col("n") < last).withColumn("n", F.col("n") + 1).join(now, ["n", *self.key], "left_anti").withColumn("change", F.lit("remove"))
            # changes first: a batch that is lost in between finds the older snapshot again
            self.changes.write(added.unionByName(gone).join(polls, "n").select("poll", *self.key, "change"), batch_id)
            self.snapshots.write(now.where(F.col("n") == last).select(*self.key), batch_id)
        rows.unpersist()


# ---- jobs after so many rows ------------------------------------------------------------


class CountTrigger:
    """A job each time the number of rows seen passes another multiple of ``every``."""

    def __init__(self, spark: SparkSession, path: str, every: int = 50):
        self.every, self.totals, self.jobs = every, Ledger(spark, f"{path}/totals"), Ledger(spark, f"{path}/jobs")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        past = self.totals.before(batch_id)
        old = past.first()["total"] if past is not None else 0
        new = old + batch.count()
        steps = batch.sparkSession.range(old // self.every + 1, new // self.every + 1)
        self.jobs.write(steps.select(F.lit("calibrate_fusion").alias("job"), (F.col("id") * self.every).alias("count")), batch_id)
        self.totals.write(batch.sparkSession.range(1).select(F.lit(new).cast("long").alias("total")), batch_id)


# ---- pages after the graph --------------------------------------------------------------

# fixed values: the kinds of published events
EVENTS = ("threshold", "pipeline_stage", "agent_trace", "scenario.promoted")


def event(kind: str, **fields: Column) -> Column:
    """A published event as JSON."""
    if kind not in EVENTS:
        raise ValueError(f"no event {kind}")
    return F.to_json(F.struct(F.lit(kind).alias("type"), *[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


class GatedPages:
    """Synthesised texts: first the episodes of the graph, then the pages, then the events.

    A page is only written after its episode's write has finished, and only if it is valid; else the old page stays.
    Of several pages of an entity in a batch the last by (observed_at, signal_id) counts. A batch that is lost between
    the steps runs again and overwrites what it had written.
    """

    def __init__(self, spark: SparkSession, path: str, valid: Column):
        self.valid = valid
        self.graph, self.pages, self.events = (Ledger(spark, f"{path}/{n}") for n in ("graph", "pages", "events"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        self.graph.write(rows.select("signal_id", F.concat_ws("_", "source", "signal_id").alias("name"), "text", "observed_at"), batch_id)
        cols = [c for c in rows.columns if c != "entity"]
        newest = rows.where(F.coalesce(self.valid, F.lit(False))).groupBy("entity").agg(F.max_by(F.struct(*cols), F.struct("observed_at", "signal_id")).alias("r")).select("entity", "r.*")
        self.pages.write(newest.select("entity", "signal_id", "text", "observed_at"), batch_id)
        told = [
            event("threshold", band=F.col("band"), entity=F.col("entity"), score=F.round("score", 4), scenario_ref=F.lit(None).cast("string")),
            event("pipeline_stage", stage=F.lit("synthesis"), entity=F.col("entity"), signal_id=F.col("signal_id")),
            event("agent_trace", agent=F.lit("synthesis"), action=F.concat(F.lit("page of "), "entity"), status=F.when(self.valid, "done").otherwise("kept")),
            F.when(F.col("band").isin("action", "critical"), event("scenario.promoted", entity=F.col("entity"), signal_id=F.col("signal_id"))),
        ]
        self.events.write(rows.select("signal_id", F.explode(F.array(*told)).alias("event")).where("event is not null"), batch_id)
        rows.unpersist()

    def current(self) -> DataFrame:
        """The page of each entity."""
        all_pages = self.pages.read()
        cols = [c for c in all_pages.columns if c not in ("entity", "batch")]
        return all_pages.groupBy("entity").agg(F.max_by(F.struct(*cols), "batch").alias("r")).select("entity", "r.*")


# ---- rows in order, after the watermark -------------------------------------------------


class Ordered:
    """Base of effects on micro-batches of ``stateful.passed``; subclasses have ``step(rows, old, batch_id)``.

    ``rows`` are the micro-batch's, written first, since a step reads them more than once; ``old`` is what the
    micro-batches before left in ``memory``. A micro-batch without rows changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.rows, self.out, self.memory = (Ledger(spark, f"{path}/{n}") for n in ("rows", "out", "memory"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.rows.write(batch, batch_id)
        rows, old = self.rows.part(batch_id), self.memory.before(batch_id)
        if old is None or not rows.isEmpty():
            each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
            self.step(rows.withColumn("_copy", each).drop("_copy", "copies"), old, batch_id)

    def step(self, rows: DataFrame, old: DataFrame | None, batch_id: int) -> None:
        raise NotImplementedError


class Flushes(Ordered):
    """Batches of ``size`` signals of an entity by (ts, event_id); a signal counts under each of its ``entity_refs``.

    ``out`` has (entity, flush, held: its signals), the unfinished ones as of each micro-batch too. Of the past an
    entity has the number of its flushes and fewer than ``size`` signals. No task orders more of an entity than an hour.
    """

    def __init__(self, spark: SparkSession, path: str, size: int = FLUSH_SIZE):
        super().__init__(spark, path)
        self.size = size

    def step(self, rows: DataFrame, old: DataFrame | None, batch_id: int) -> None:
        each = rows.select(F.explode(F.array_distinct("entity_refs")).alias("entity"), "ts", "event_id").where("entity is not null")
        if old is not None:
            each = each.unionByName(old.select("entity", F.inline("held")))
        d = numbered(each, "entity", "ts", "event_id", "hour").withColumn("flush", F.floor((F.col("rn") - 1) / self.size))
        groups = d.groupBy("entity", "flush").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("held"))
        if old is not None:
            groups = groups.join(old.select("entity", "n"), "entity", "left").select("entity", (F.col("flush") + F.coalesce("n", F.lit(0))).alias("flush"), "held")
        self.out.write(groups, batch_id)
        done, full = self.out.part(batch_id), F.size("held") == self.size
        counts = done.select("entity", (F.col("flush") + F.when(full, 1).otherwise(0)).alias("n"))
        if old is not None:
            counts = counts.unionByName(old.select("entity", "n"))
        rest = done.where(~full).select("entity", "held")
        self.memory.write(counts.groupBy("entity").agg(F.max("n").alias("n")).join(rest, "entity", "left"), batch_id)

    def flushes(self) -> DataFrame:
        """(entity, flush, ids, observed_at) of the batches that are full."""
        return self.out.read().where(F.size("held") == self.size).select("entity", "flush", F.col("held.event_id").alias("ids"), F.array_max("held.ts").alias("observed_at"))


class Tracks(Ordered):
    """Silence, spread of speeds, score and dark flag of each position of (vessel, event_id, ts, speed, monitored), by (ts, event_id).

    ``out`` has a row a position, ``known`` where its vessel was seen within ``ttl_h`` hours before. Of the past there
    are the last 49 positions of the vessels that may still be known to later micro-batches; the others are forgotten.
    """

    COLUMNS = ["vessel", "event_id", "ts", "speed", "monitored"]
    BEFORE = 49  # positions before one that its spread looks back on

    def __init__(self, spark: SparkSession, path: str, ttl_h: int = VESSEL_TTL_H, size: int = signals.CHUNK):
        super().__init__(spark, path)
        self.ttl_h, self.size = ttl_h, size

    def step(self, rows: DataFrame, old: DataFrame | None, batch_id: int) -> None:
        d = rows.select(*self.COLUMNS, F.lit(True).alias("_new"))
        if old is not None:
            d = d.unionByName(old.withColumn("_new", F.lit(False)))
        # a key in a struct is never null itself, so positions without a vessel stay in its joins
        g = signals.gaps(d.withColumn("_vessel", F.struct("vessel")), "_vessel", "ts", "event_id", "speed", self.size, self.ttl_h)
        self.out.write(g.where("_new").select("vessel", "event_id", "gap_h", "speed_std", "score", "dark", F.col("gap_h").isNotNull().alias("known")), batch_id)
        last = Window.partitionBy("vessel").orderBy(F.desc("ts"), F.desc("event_id"))
        tail = d.withColumn("_back", F.row_number().over(last)).where(F.col("_back") <= self.BEFORE)
        # whatever comes later is later than the newest position here
        newest = d.agg(F.max("ts").alias("_newest"))
        kept = tail.withColumn("_last", F.max("ts").over(Window.partitionBy("vessel"))).join(F.broadcast(newest))
        self.memory.write(kept.where(F.col("_last") > F.col("_newest") - F.make_interval(hours=F.lit(self.ttl_h))).select(*self.COLUMNS), batch_id)
