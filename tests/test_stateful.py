"""Stateful processors and effects of micro-batches: arrival order, restarts, losses between steps."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.streaming import commits, jobs, stateful


def streamed(spark, tmp_path, name, parts, job):
    """Rows of the job's micro-batches; each part is a run of its own from one checkpoint."""
    rows, src = [], str(tmp_path / f"{name}-in")
    for part in parts:
        part.write.mode("append").parquet(src)
        q = jobs.run_available(job(spark.readStream.schema(parts[0].schema).parquet(src)), lambda b, i: rows.extend(b.collect()), str(tmp_path / f"{name}-cp"))
        assert q.awaitTermination(240)
    return rows


def closing(spark, rows, schema, ts, far):
    """The rows and, in a run of its own, one far later row that moves the watermark past all of them."""
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(ts)).drop(ts), spark.createDataFrame([far], schema).withColumn("ts", F.timestamp_seconds(ts)).drop(ts)


T0 = 1_700_000_000


def test_vessels_forget_and_do_not_depend_on_arrival(spark, tmp_path):
    r = random.Random(1)
    rows = [(1, i, T0 + 3600 * h, float(r.randint(0, 20)), True) for i, h in enumerate([0, 1, 2, 8, 40, 41, 42, 43])] + [(2, 100 + i, T0 + 60 * i, float(i % 7), False) for i in range(70)]
    schema = "vessel int, event_id long, s long, speed double, monitored boolean"
    outs = []
    for seed, cut in ((3, 10), (4, 60)):
        mixed = list(rows)
        random.Random(seed).shuffle(mixed)
        first = [x for x in mixed if x[2] <= T0 + 3600 * cut]
        second = [x for x in mixed if x[2] > T0 + 3600 * cut]
        a, far = closing(spark, first, schema, "s", (9, 999, T0 + 10**7, 0.0, False))
        parts = [a.repartition(3)] + ([closing(spark, second, schema, "s", rows[0])[0].repartition(2)] if second else []) + [far]
        outs.append(sorted((x.event_id, x.gap_h, x.speed_std and round(x.speed_std, 9), x.score, x.dark, x.known) for x in streamed(spark, tmp_path, f"v{seed}", parts, stateful.tracks) if x.vessel != 9))
    assert outs[0] == outs[1] and len(outs[0]) == len(rows)
    got = {x[0]: x for x in outs[0]}
    assert [got[i][1] for i in range(8)] == [None, 1.0, 1.0, 6.0, None, 1.0, 1.0, 1.0] and [got[i][5] for i in range(8)] == [False, True, True, True, False, True, True, True]
    assert got[3][4] and not got[4][4] and got[4][2] is None  # after 32 hours its speeds are gone too
    last = [float(i % 7) for i in range(20, 70)]
    assert got[169][2] == pytest.approx((sum((x - sum(last) / 50) ** 2 for x in last) / 50) ** 0.5)


def test_pending_timers(spark, tmp_path):
    h = lambda x: T0 + round(3600 * x)
    rows = [("a", 0, h(0), "elevated"), ("a", 1, h(10), "calm"), ("a", 2, h(20), "elevated"), ("a", 3, h(72), "action"), ("b", 0, h(0), "watch"), ("b", 1, h(1), "elevated"), ("b", 2, h(2), "elevated"), ("b", 3, h(73.001), "critical"), ("c", 0, h(5), "elevated"), ("d", 0, h(5), "critical")]
    schema = "entity string, flush long, s long, band string"
    first, far = closing(spark, [x for x in rows if x[2] <= h(20)], schema, "s", ("z", 0, h(400), "calm"))
    second, _ = closing(spark, [x for x in rows if x[2] > h(20)], schema, "s", ("z", 0, h(400), "calm"))
    got = streamed(spark, tmp_path, "p", [first, second, far], lambda d: stateful.pending(d.withColumnRenamed("ts", "observed_at")))
    assert sorted((x.entity, (x.opened_us // 10**6 - T0) / 3600, x.outcome, round((x.at_us / 10**6 - T0) / 3600, 3)) for x in got) == [("a", 0, "promoted", 72), ("a", 20, "promoted", 72), ("b", 1, "expired", 73), ("c", 5, "expired", 77)]


def test_flushes_count_under_every_entity(spark, tmp_path):
    rows = [(i, T0 + i, ["x", "y", "x"] if i % 2 else ["y", None]) for i in range(25)] + [(90, T0, None), (91, T0, [])]
    first, far = closing(spark, rows[:12] + rows[25:], "event_id long, s long, entity_refs array<string>", "s", (99, T0 + 9999, ["z"]))
    second, _ = closing(spark, rows[12:25], "event_id long, s long, entity_refs array<string>", "s", (99, T0 + 9999, ["z"]))
    got = streamed(spark, tmp_path, "f", [first, second, far], stateful.fanned_flushes)
    assert sorted((x.entity, x.flush, x.ids) for x in got) == [("x", 0, list(range(1, 21, 2))), ("y", 0, list(range(10))), ("y", 1, list(range(10, 20)))]


def test_deferred_closes_early_or_when_the_day_turns(spark, tmp_path):
    day = T0 - T0 % 86400
    at = lambda h, m=0: day + 3600 * h + 60 * m
    rows = [("a", 1, at(1), "news", "LOW", False, "one", 0.1), ("a", 2, at(2), "gdelt", "HIGH", False, "two", None), ("a", 3, at(3), "news", "MED", False, "hot", 0.8), ("a", 4, at(4), "news", "MED", False, "four", 0.2), ("a", 5, at(23, 50), "news", "LOW", True, "next", 0.2), ("b", 6, at(23, 49), "news", "LOW", False, "alone", 0.0)] + [("c", 100 + i, at(5, i), "news", "LOW", i == 9, f"s{i}", 0.0) for i in range(30)]
    schema = "entity string, event_id long, s long, source string, priority string, force boolean, summary string, score double"
    first, far = closing(spark, rows[:2] + rows[6:], schema, "s", ("z", 0, at(100), "news", "LOW", False, "", 0.0))
    second, _ = closing(spark, rows[2:6], schema, "s", ("z", 0, at(100), "news", "LOW", False, "", 0.0))
    # the second run's rows are older than the first one's newest, but not late
    got = {(x.entity, x.closed_us // 10**6): x for x in streamed(spark, tmp_path, "d", [first, second, far], lambda d: stateful.deferred(d, "12 hours"))}
    assert sorted(got) == [("a", at(3)), ("a", at(23, 50)), ("a", at(47, 50)), ("b", at(23, 50)), ("c", at(23, 50))]
    a = got["a", at(3)]
    assert a.early and a.anchor == 2 and a.n == 3 and a.text == "two\n\nAdditional signals accumulated since last synthesis (2 more):\n• [NEWS 2023-11-14] hot\n• [NEWS 2023-11-14] one"
    c = got["c", at(23, 50)]
    assert c.anchor == 109 and c.n == 30 and c.text.startswith("s9\n\nAdditional signals accumulated since last synthesis (29 more):\n• [NEWS 2023-11-14] s0\n") and c.text.count("•") == 20
    assert got["b", at(23, 50)].text == "alone" and not got["b", at(23, 50)].early


def test_list_changes(spark, tmp_path):
    of = lambda *polls: spark.createDataFrame([(p, k) for p, keys in polls for k in keys], "poll int, uid string")
    e = commits.ListChanges(spark, str(tmp_path / "l"), ["uid"])
    e(of((1, "ab"), (2, "bc")), 0)
    e(of((3, "bcdd")), 1)
    e(of((3, "bcdd")), 1)  # the batch runs again
    e(of(), 2)  # a failed poll
    e(of((7, "a"), (9, "")), 3)
    assert sorted((x.poll, x.uid, x.change) for x in e.changes.read().collect()) == [(1, "a", "add"), (1, "b", "add"), (2, "a", "remove"), (2, "c", "add"), (3, "d", "add"), (7, "a", "add"), (7, "b", "remove"), (7, "c", "remove"), (7, "d", "remove")]


def test_a_loss_between_snapshot_steps(spark, tmp_path, monkeypatch):
    of = lambda p, keys: spark.createDataFrame([(p, k) for k in keys], "poll int, uid string")
    e = commits.ListChanges(spark, str(tmp_path / "l"), ["uid"])
    e(of(1, "ab"), 0)
    monkeypatch.setattr(e.snapshots, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        e(of(2, "bc"), 1)
    monkeypatch.undo()
    e(of(2, "bc"), 1)
    e(of(3, "c"), 2)
    assert sorted((x.poll, x.uid, x.change) for x in e.changes.read().collect()) == [(1, "a", "add"), (1, "b", "add"), (2, "a", "remove"), (2, "c", "add"), (3, "b", "remove")]


def test_retrain_fires_once_a_crossing(spark, tmp_path):
    e = commits.CountTrigger(spark, str(tmp_path / "c"), 50)
    for i, n in enumerate([49, 1, 0, 149, 1, 1]):
        e(spark.range(n), i)
        e(spark.range(n), i)
    again = commits.CountTrigger(spark, str(tmp_path / "c"), 50)  # a new driver
    again(spark.range(49), 6)
    assert sorted(x["count"] for x in again.jobs.read().collect()) == [50, 100, 150, 200, 250]


def test_pages_follow_the_graph(spark, tmp_path, monkeypatch):
    row = lambda i, e, text, band="calm": (f"s{i}", "news", e, text, i, 0.5, band)
    of = lambda *rows: spark.createDataFrame(list(rows), "signal_id string, source string, entity string, text string, o long, score double, band string").withColumn("observed_at", F.timestamp_seconds("o")).drop("o")
    e = commits.GatedPages(spark, str(tmp_path / "p"), F.length("text") > 3)
    first = of(row(1, "x", "long one"), row(2, "x", "long two", "critical"), row(3, "y", "no"))
    monkeypatch.setattr(e.graph, "write", lambda *a: (_ for _ in ()).throw(OSError("graph")))
    with pytest.raises(OSError):
        e(first, 0)
    assert e.pages.ids() == []  # no page without its episode
    monkeypatch.undo()
    monkeypatch.setattr(e.pages, "write", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        e(first, 0)
    assert e.graph.ids() == [0] and e.pages.ids() == []
    monkeypatch.undo()
    e(first, 0)
    e(of(row(4, "x", "bad"), row(5, "y", "fine now")), 1)
    assert sorted(r.name for r in e.graph.read().collect()) == [f"news_s{i}" for i in range(1, 6)]
    assert sorted((r.entity, r.text, r.signal_id) for r in e.current().collect()) == [("x", "long two", "s2"), ("y", "fine now", "s5")]
    kinds = sorted((r.signal_id, r.type) for r in e.events.read().select("signal_id", F.get_json_object("event", "$.type").alias("type")).collect())
    assert [k for s, k in kinds if s == "s2"] == ["agent_trace", "pipeline_stage", "scenario.promoted", "threshold"] and len(kinds) == 16
    with pytest.raises(ValueError):
        commits.event("other")


def in_batches(effect, rows, schema, cuts, monkeypatch):
    """The rows by time in micro-batches, each lost once before its memory is written and then run again."""
    for i, (a, b) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = effect.memory.spark.createDataFrame([(*r, 1 + (r[0] % 10 == 3)) for r in rows[a:b]], schema + ", s long, copies long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        with monkeypatch.context() as m:
            m.setattr(effect.memory, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            if a != b:
                with pytest.raises(OSError):
                    effect(part, i)
        effect(part, i)
        effect(part, i)
    return sorted(r[:-1] for r in rows for _ in range(1 + (r[0] % 10 == 3)))


def test_flushes_go_on_over_micro_batches(spark, tmp_path, monkeypatch):
    rows = [(i, [["x", "y"], ["x", None, "x"], ["z"] if i < 20 else None][i % 3], T0 + 900 * i) for i in range(90)]
    e = commits.Flushes(spark, str(tmp_path / "f"), 4)
    seen = in_batches(e, rows, "event_id long, entity_refs array<string>", [7, 8, 8, 50, 89], monkeypatch)
    want = []
    for n in "xyz":
        ids = [i for i, refs in seen if refs and n in refs]
        want += [(n, k, ids[4 * k : 4 * k + 4], T0 + 900 * ids[4 * k + 3]) for k in range(len(ids) // 4)]
    assert sorted((r.entity, r.flush, r.ids, r.s) for r in e.flushes().withColumn("s", F.unix_seconds("observed_at")).collect()) == want
    left = {r.entity: (r.n, len(r.held or [])) for r in e.memory.part(5).collect()}
    assert left == {n: divmod(sum(n in (refs or []) for _, refs in seen), 4) for n in "xyz"}


def test_tracks_go_on_over_micro_batches(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    times = [0]
    for _ in range(239):
        times.append(times[-1] + r.choice([60, 600, 3600] if len(times) != 100 else [90_000]))
    rows = [(i, i % 9 == 5 and 2 or 1, None if i % 8 == 6 else float(r.randint(0, 20)), i % 4 == 0, T0 + t) for i, t in enumerate(times)]
    e = commits.Tracks(spark, str(tmp_path / "t"), size=64)
    in_batches(e, rows, "event_id long, vessel int, speed double, monitored boolean", [30, 99, 130, 130, 131], monkeypatch)
    got = sorted((x.event_id, x.gap_h, x.speed_std, x.known) for x in e.out.read().collect())
    want = []
    for v in (1, 2):
        life, last = [], None
        for i, _, speed, _, t in [x for x in rows if x[1] == v for _ in range(1 + (x[0] % 10 == 3))]:
            gap = None if last is None or t - last > 86400 else (t - last) / 3600
            life, last = ([] if gap is None else life) + [speed], t
            s = [x for x in life[-50:] if x is not None]
            want.append((i, gap, (sum((x - sum(s) / len(s)) ** 2 for x in s) / len(s)) ** 0.5 if len(s) >= 3 else None, gap is not None))
    want.sort(key=lambda x: (x[0], x[1] == 0))
    got.sort(key=lambda x: (x[0], x[1] == 0))
    assert [(x[0], x[3]) for x in got] == [(x[0], x[3]) for x in want]
    for g, w in zip(got, want):
        assert [x is None for x in g[1:3]] == [x is None for x in w[1:3]] and [x or 0 for x in g[1:3]] == pytest.approx([x or 0 for x in w[1:3]])


class Handle:
    """State of one key in this process; counts the held rows that were read."""

    def __init__(self):
        self.values, self.lists, self.maps, self.timers, self.read = {}, {}, {}, set(), 0

    def getValueState(self, name, schema):
        s = self.values
        return SimpleNamespace(exists=lambda: name in s, get=lambda: s[name], update=lambda v: s.__setitem__(name, v), clear=lambda: s.pop(name, None))

    def getListState(self, name, schema):
        s = self.lists.setdefault(name, [])
        return SimpleNamespace(exists=lambda: bool(s), get=lambda: [self._seen(r, 1) for r in s], appendList=s.extend, put=lambda v: s.__setitem__(slice(None), v), clear=s.clear)

    def getMapState(self, name, key, schema):
        s = self.maps.setdefault(name, {})
        return SimpleNamespace(getValue=lambda k: self._seen(s[k], len(s[k][0])), updateValue=s.__setitem__, removeKey=s.pop)

    def _seen(self, v, n):
        self.read += n
        return v

    def registerTimer(self, ms):
        self.timers.add(ms)


def test_a_call_reads_a_day_at_a_time():
    p, h, hour = stateful._Pending(72), Handle(), 3_600_000
    p.init(h)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    frames = (pd.DataFrame({"t": [hour * 1000 * i for i in hours], "id": list(hours), "band": [["calm", "elevated", "action"][i % 3] for i in hours]}) for hours in (range(1, 240, 2), range(2, 240, 2)))
    assert not list(p.handleInputRows(("a",), frames, at(0))) and h.timers == {hour}
    got = p.handleExpiredTimer(("a",), at(200 * hour + 1), None)
    first = next(got)
    assert 0 < len(first) < 10 and h.read == 23  # the first day has no hour 0
    rows = pd.concat([first, *got])
    assert rows.opened_us.tolist() == [3_600_000_000 * i for i in range(1, 200, 3)] and set(rows.outcome) == {"promoted"} and h.read == 215
    assert min(t for t in h.timers if t > 200 * hour) == 201 * hour
    later = pd.concat(p.handleExpiredTimer(("a",), at(500 * hour), None))
    assert later.opened_us.tolist() == [3_600_000_000 * i for i in range(202, 240, 3)] and not h.maps["held"]
