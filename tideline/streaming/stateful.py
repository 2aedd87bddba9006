"""Rules with memory as stateful processors: event-time timers, bounded state, results that don't depend on arrival.

Every processor holds an entity's rows until the watermark has passed them and then takes them in the order
of (time, id), so the result is the same however rows are spread over micro-batches, and a restart from the
checkpoint goes on where it stopped. Held rows lie in slots of a day, and a call has one slot of an entity at a time.
A timer always stands at the earliest thing an entity waits for. Rows at or before the watermark are late and are
dropped; what the watermark has not passed yet comes out in a later run.

Times are microseconds in state and output columns; timers and watermarks are whole milliseconds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..constants import FLUSH_SIZE, INGEST_IMMEDIATE, PENDING_TTL_H

#: The store that these processors need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
HOUR = 3_600_000_000
#: Held rows lie in slots of a day; one at a time is read.
SLOT = 24 * HOUR
VESSEL_TTL_H, VESSEL_SPEEDS = 24, 50
#: Minutes after which a day's batch counts as the next day's: days turn at 23:50.
DAY_TURN_MIN = 10


def prepare(spark: SparkSession) -> None:
    for k, v in STORE.items():
        spark.conf.set(k, v)


def passed(rows: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The rows of a stream and the number of their ``copies``, once the watermark has passed them; late ones are dropped.

    What waits is grouped by whole rows, so it is dealt over tasks by rows, however few entities they name. Each
    micro-batch of the result is later than those before it, so an effect (``commits``) can take it in order.
    """
    prepare(rows.sparkSession)
    return rows.where(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(*rows.columns).agg(F.count("*").alias("copies"))


class InOrder(StatefulProcessor):
    """Base of the processors: ``row`` names the columns of a held row, ``t`` and ``id`` first; subclasses have

    ``memory``: the schema of what an entity remembers, ``start``: its first value;
    ``take(key, memory, row, out)``: the memory after a row; ``due(key, memory, now, out)``: after time alone;
    ``wakes(memory)``: when time alone will matter next, in microseconds, or None.
    """

    columns: list[tuple[str, str]] = []
    memory: str = ""
    start: tuple = ()
    out: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slot long, part long", ", ".join(f"{n} array<{t}>" for n, t in self.columns))
        self.slots = handle.getValueState("slots", "slot array<long>, parts array<long>, first array<long>")
        self.state = handle.getValueState("memory", self.memory)

    def take(self, key: tuple, memory: tuple, row: tuple, out: list) -> tuple:
        raise NotImplementedError

    def due(self, key: tuple, memory: tuple, now: int, out: list) -> tuple:
        return memory

    def wakes(self, memory: tuple) -> int | None:
        return None

    def _remembered(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else self.start

    def _watch(self, times: list[int | None]) -> None:
        known = [t for t in times if t is not None]
        if known:
            self.handle.registerTimer(-(-min(known) // 1000))

    def _waiting(self) -> dict[int, tuple[int, int]]:
        """(parts, earliest time) of each slot with held rows."""
        return {s: (n, t) for s, n, t in zip(*self.slots.get())} if self.slots.exists() else {}

    def _wait(self, waiting: dict[int, tuple[int, int]]) -> None:
        if waiting:
            self.slots.update(tuple(map(list, zip(*((s, n, t) for s, (n, t) in waiting.items())))))
        else:
            self.slots.clear()

    def _hold(self, waiting: dict[int, tuple[int, int]], rows: list[tuple]) -> None:
        """The rows as one more part of each of their slots."""
        by_slot: dict[int, list[tuple]] = {}
        for r in rows:
            by_slot.setdefault(r[0] // SLOT, []).append(r)
        for slot, part in by_slot.items():
            n, first = waiting.get(slot, (0, part[0][0]))
            self.held.updateValue((slot, n), tuple(map(list, zip(*part))))
            waiting[slot] = n + 1, min(first, *(r[0] for r in part))

    def _let_go(self, waiting: dict[int, tuple[int, int]], slot: int) -> list[tuple]:
        """The rows of a slot in order, which holds them no more."""
        rows: list[tuple] = []
        for i in range(waiting.pop(slot)[0]):
            rows += zip(*self.held.getValue((slot, i)))
            self.held.removeKey((slot, i))
        return sorted(rows, key=lambda r: r[:2])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = self._waiting()
        first = None
        for frame in rows:
            got = (tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in frame[[n for n, _ in self.columns]].itertuples(index=False, name=None))
            fresh = [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in got if now <= 0 or r[0] > now]
            if fresh:
                self._hold(waiting, fresh)
                first = min(r[0] for r in fresh) if first is None else min(first, *(r[0] for r in fresh))
        if first is not None:
            self._wait(waiting)
            self._watch([first])
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, memory = self._waiting(), self._remembered()
        passed_slots = sorted(s for s, (_, first) in waiting.items() if first <= now)
        for slot in passed_slots:
            out: list = []
            rest = []
            for r in self._let_go(waiting, slot):
                if r[0] <= now:
                    memory = self.take(key, self.due(key, memory, r[0] - 1, out), r, out)
                else:
                    rest.append(r)
            if rest:
                self._hold(waiting, rest)
            if out:
                yield pd.DataFrame(out, columns=self.out)
        out = []
        memory = self.due(key, memory, now, out)
        if passed_slots:
            self._wait(waiting)
        if memory == self.start:
            self.state.clear()
        else:
            self.state.update(memory)
        self._watch([*(first for _, first in waiting.values()), self.wakes(memory)])
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, processor: InOrder, schema: str) -> DataFrame:
    prepare(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp")).alias("t")


# ---- signals counted under each of their entities ---------------------------------------


class _Flush(InOrder):
    columns = [("t", "long"), ("id", "long")]
    memory, start = "n long, ids array<long>, times array<long>", (0, [], [])
    out = ["entity", "flush", "ids", "observed_us"]

    def __init__(self, size: int):
        self.size = size

    def take(self, key, memory, row, out):
        n, ids, times = memory[0], [*memory[1], row[1]], [*memory[2], row[0]]
        if len(ids) < self.size:
            return n, ids, times
        out.append((key[0], n, ids, max(times)))
        return n + 1, [], []


def fanned_flushes(signals: DataFrame, late: str = "10 minutes", size: int = FLUSH_SIZE) -> DataFrame:
    """(entity, flush, ids, observed_us) each time ``size`` more signals name an entity; a signal counts under each of its ``entity_refs``."""
    each = signals.withWatermark("ts", late).select(F.explode(F.array_distinct("entity_refs")).alias("entity"), _micros("ts"), F.col("event_id").alias("id"), "ts").where("entity is not null")
    kind = each.schema["entity"].dataType.simpleString()
    return _run(each, "entity", _Flush(size), f"entity {kind}, flush long, ids array<long>, observed_us long")


# ---- vessels ----------------------------------------------------------------------------


class _Track(InOrder):
    columns = [("t", "long"), ("id", "long"), ("speed", "double"), ("monitored", "boolean")]
    memory, start = "last long, speeds array<double>", (-1, [])
    out = ["vessel", "event_id", "gap_h", "speed_std", "score", "dark", "known"]

    def __init__(self, ttl_h: int, speeds: int):
        self.ttl, self.keep = ttl_h * HOUR, speeds

    def due(self, key, memory, now, out):
        return self.start if memory[0] >= 0 and now >= memory[0] + self.ttl else memory

    def wakes(self, memory):
        return memory[0] + self.ttl if memory[0] >= 0 else None

    def take(self, key, memory, row, out):
        t, event, speed, monitored = row
        last, speeds = memory
        gap = (t - last) / HOUR if last >= 0 else None
        speeds = [*speeds, *([] if speed is None else [speed])][-self.keep :]
        mean = sum(speeds) / len(speeds) if speeds else 0.0
        std = math.sqrt(sum((s - mean) ** 2 for s in speeds) / len(speeds)) if len(speeds) >= 3 else None
        score = 0.45 * min((gap or 0.0) / 24, 1.0) + 0.30 * min((std or 0.0) / 5, 1.0) + (0.25 if monitored else 0.0)
        out.append((key[0], event, gap, std, round(score, 6), (gap or 0.0) >= 4 and bool(monitored), last >= 0))
        return t, speeds


def tracks(pings: DataFrame, late: str = "10 minutes", ttl_h: int = VESSEL_TTL_H, speeds: int = VESSEL_SPEEDS) -> DataFrame:
    """Silence, spread of the last ``speeds`` speeds, score and dark flag of each position of (vessel, event_id, ts, speed, monitored).

    A vessel that has been silent for more than ``ttl_h`` hours is forgotten: a timer clears its state, and
    when it is seen again it is new (``known`` is false, no gap, no speeds).
    """
    rows = pings.withWatermark("ts", late).select("vessel", _micros("ts"), F.col("event_id").alias("id"), "speed", "monitored", "ts")
    kind = rows.schema["vessel"].dataType.simpleString()
    return _run(rows, "vessel", _Track(ttl_h, speeds), f"vessel {kind}, event_id long, gap_h double, speed_std double, score double, dark boolean, known boolean")


# ---- pending scenarios ------------------------------------------------------------------


class _Pending(InOrder):
    columns = [("t", "long"), ("id", "long"), ("band", "string")]
    memory, start = "was string, opened array<long>", ("calm", [])
    out = ["entity", "opened_us", "outcome", "at_us"]

    def __init__(self, ttl_h: int):
        self.ttl = ttl_h * HOUR

    def due(self, key, memory, now, out):
        gone = [t for t in memory[1] if now >= t + self.ttl]
        out += [(key[0], t, "expired", t + self.ttl) for t in gone]
        return (memory[0], [t for t in memory[1] if t not in gone]) if gone else memory

    def wakes(self, memory):
        return min(memory[1]) + self.ttl if memory[1] else None

    def take(self, key, memory, row, out):
        t, _, band = row
        was, opened = memory
        if band in ("action", "critical"):
            met = [o for o in opened if o < t]
            out += [(key[0], o, "promoted", t) for o in met]
            opened = [o for o in opened if o >= t]
        elif band == "elevated" and was in ("calm", "watch"):
            opened = [*opened, t]
        return band, opened


def pending(states: DataFrame, late: str = "10 minutes", ttl_h: int = PENDING_TTL_H) -> DataFrame:
    """What became of each rise into ``elevated`` of (entity, observed_at, flush, band): (entity, opened_us, outcome, at_us).

    It is ``promoted`` by the entity's next action or critical state within ``ttl_h`` hours, else ``expired`` when
    its timer fires.
    """
    rows = states.withWatermark("observed_at", late).select("entity", _micros("observed_at"), F.col("flush").cast("long").alias("id"), "band", "observed_at")
    kind = rows.schema["entity"].dataType.simpleString()
    return _run(rows, "entity", _Pending(ttl_h), f"entity {kind}, opened_us long, outcome string, at_us long")


# ---- deferred batches -------------------------------------------------------------------

_PRIORITY = {"HIGH": 0, "MED": 1, "LOW": 2}


def consolidated(items: list[tuple[int, int, str, str, bool, str, str]], extras: int = 20) -> tuple[int, str]:
    """(id of the anchor, one text) of (t, id, source, priority, force, day, summary) rows: the anchor's summary, then up to ``extras`` others."""
    order = sorted(items, key=lambda r: (not r[4], _PRIORITY.get(r[3], 2), r[0], r[1]))
    text = order[0][6]
    if len(order) > 1:
        lines = "\n".join(f"• [{r[2].upper()} {r[5]}] {r[6]}" for r in order[1 : extras + 1])
        text = f"{text}\n\nAdditional signals accumulated since last synthesis ({len(order) - 1} more):\n{lines}"
    return order[0][1], text


class _Deferred(InOrder):
    columns = [("t", "long"), ("id", "long"), ("source", "string"), ("priority", "string"), ("force", "boolean"), ("day", "string"), ("summary", "string"), ("score", "double")]
    memory, start = "closes long, t array<long>, id array<long>, source array<string>, priority array<string>, force array<boolean>, day array<string>, summary array<string>", (-1, [], [], [], [], [], [], [])
    out = ["entity", "closed_us", "early", "anchor", "n", "text"]
    DAY = 24 * HOUR

    def __init__(self, threshold: float, turn_min: int, extras: int):
        self.threshold, self.turn, self.extras = threshold, turn_min * 60_000_000, extras

    def _close(self, key, memory, at, early, out):
        items = list(zip(*memory[1:]))
        if items:
            anchor, text = consolidated(items, self.extras)
            out.append((key[0], at, early, anchor, len(items), text))
        return self.start

    def due(self, key, memory, now, out):
        return self._close(key, memory, memory[0], False, out) if 0 <= memory[0] <= now else memory

    def wakes(self, memory):
        return memory[0] if memory[0] >= 0 else None

    def take(self, key, memory, row, out):
        if memory[0] >= 0 and memory[0] <= row[0]:
            memory = self._close(key, memory, memory[0], False, out)
        closes = memory[0] if memory[0] >= 0 else ((row[0] + self.turn) // self.DAY + 1) * self.DAY - self.turn
        memory = (closes, *[[*held, v] for held, v in zip(memory[1:], row[:7])])
        if row[7] is not None and row[7] >= self.threshold:
            return self._close(key, memory, row[0], True, out)
        return memory


def deferred(signals: DataFrame, late: str = "10 minutes", threshold: float = INGEST_IMMEDIATE, turn_min: int = DAY_TURN_MIN, extras: int = 20) -> DataFrame:
    """(entity, closed_us, early, anchor, n, text): what gathers under an entity until its day turns, or until a signal's score reaches ``threshold``.

    Of (entity, event_id, ts, source, priority, force, summary, score). The signal that reaches the threshold is the last one of its batch.
    """
    rows = signals.withWatermark("ts", late).select("entity", _micros("ts"), F.col("event_id").alias("id"), "source", "priority", "force", F.date_format("ts", "yyyy-MM-dd").alias("day"), "summary", "score", "ts")
    kind = rows.schema["entity"].dataType.simpleString()
    return _run(rows, "entity", _Deferred(threshold, turn_min, extras), f"entity {kind}, closed_us long, early boolean, anchor long, n long, text string")
