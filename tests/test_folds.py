"""Rules as scans: maps of stretches against a plain walk over the rows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.operators import alerts, signals
from tideline.operators.folds import Cooldown, Crossing, applied, composed, fired, fold, summary

RULES = [Cooldown(5e-6), Crossing(5e-6), Crossing(0), Cooldown(0)]
ROWS = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=40)


def plain(rule, times, values, label, at):
    """The rule as it is told, row by row."""
    out = []
    for i, (t, v) in enumerate(zip(times, values)):
        rested = at is None or t - at >= rule.wait
        if isinstance(rule, Cooldown):
            if rested:
                out, at = [*out, i], t
        elif v >= 3 and v > label and rested:
            out, label, at = [*out, i], v, t
        elif v < 2:
            label = 0
    return out, label, at


@settings(max_examples=400, deadline=None)
@given(ROWS, st.sampled_from(RULES), st.lists(st.integers(1, 39), max_size=4), st.integers(-9, 0), st.sampled_from([0, 3, 4]))
def test_maps_compose(steps, rule, cuts, ago, label):
    times = [sum(d for d, _ in steps[: i + 1]) for i in range(len(steps))]
    values = [v for _, v in steps]
    label = label if label in rule.labels else 0
    for at in (None, times[0] + ago):
        want = plain(rule, times, values, label, at)
        assert fired(rule, times, values, label, at) == want
        edges = sorted({0, len(times), *(c for c in cuts if c < len(times))})
        maps = [summary(rule, times[a:b], values[a:b]) for a, b in zip(edges, edges[1:])]
        state = (label, at)
        for m in maps:
            state = applied(m, *state)
        assert state == want[1:]
        # any bracketing gives the same map
        left, right = maps[0], maps[-1]
        for m in maps[1:]:
            left = composed(left, m)
        for m in reversed(maps[:-1]):
            right = composed(m, right)
        assert applied(left, label, at) == applied(right, label, at) == want[1:]


@pytest.mark.parametrize("rule,size,fan", [(Cooldown(40), 7, 3), (Crossing(40), 7, 3), (Crossing(40), 64, 4096)])
def test_fold_of_a_hot_entity(spark, rule, size, fan):
    r = random.Random(size)
    rows, t = [], 1_700_000_000
    for i in range(600):
        t += r.choice([0, 1, 5, 30, 90])
        rows.append(("hot" if i % 10 else f"e{r.randint(0, 3)}", t, i, r.randint(0, 4)))
    df = spark.createDataFrame(rows, "entity string, s long, id long, v int").withColumn("ts", F.timestamp_seconds("s"))
    got = {(x.entity, x.id): (x.n, x.fired) for x in fold(df, "entity", "ts", "id", "v", rule, size, fan).collect()}
    for e in {x[0] for x in rows}:
        mine = sorted((s, i, v) for x, s, i, v in rows if x == e)
        hits = set(plain(rule, [s * 1_000_000 for s, _, _ in mine], [v for _, _, v in mine], 0, None)[0])
        assert [got[e, i] for _, i, _ in mine] == [(k + 1, k in hits) for k in range(len(mine))]
    assert fold(df.limit(0), "entity", "ts", "id", "v", rule, size, fan).count() == 0


def test_no_list_of_an_entity(spark):
    """3000 rows of one entity go through chunks of 50 and maps in fours; nothing gathers them."""
    df = spark.range(3000).select(F.lit(1).alias("entity"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.col("id").alias("event_id"))
    out = alerts.cooldown(df, 60, size=50, fan=4)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert sorted(r.event_id for r in out.where("kept").collect()) == list(range(0, 3000, 9))


@pytest.mark.parametrize("size", [3, 16384])
def test_as_of_over_chunks(spark, size):
    r = random.Random(2)
    rows = [(r.choice("ab"), float(r.randint(0, 400)), i) for i in range(120)]
    marks = [(r.choice("abc"), float(r.randint(50, 300)), float(i)) for i in range(9)]
    got = signals.as_of(spark.createDataFrame(rows, "k string, t double, id long"), spark.createDataFrame(marks, "k string, t double, v double"), "k", "t", "v", size).collect()
    assert len(got) == len(rows)
    import math

    for x in got:
        k, t, _ = rows[x.id]
        b = max(((m[1], m[2]) for m in marks if m[0] == k and m[1] <= t), default=None)
        a = min(((m[1], m[2]) for m in marks if m[0] == k and m[1] > t), default=None)
        want = b[1] + (a[1] - b[1]) * (t - b[0]) / (a[0] - b[0]) if a and b else b[1] * math.exp(-(t - b[0]) / 86400 / 7) if b else 0.0
        assert math.isclose(x.value, want, abs_tol=1e-9)


@pytest.mark.parametrize("size", [2, 16384])
def test_expired_over_chunks(spark, size):
    r = random.Random(4)
    bands = ["calm", "watch", "elevated", "action", "critical"]
    rows = [(r.randint(0, 2), 1_700_000_000 + 3600 * r.randint(0, 900), i, r.choice(bands)) for i in range(150)]
    df = spark.createDataFrame(rows, "entity int, s long, flush long, band string").withColumn("observed_at", F.timestamp_seconds("s"))
    got = sorted((x.entity, x.s) for x in alerts.expired(df, 72, size).select("entity", F.unix_seconds("opened_at").alias("s")).collect())
    want = []
    for e in range(3):
        mine = sorted((s, f, b) for x, s, f, b in rows if x == e)
        for i, (s, _, b) in enumerate(mine):
            if b == "elevated" and (mine[i - 1][2] if i else "calm") in ("calm", "watch") and not any(c in ("action", "critical") and s < u <= s + 72 * 3600 for u, _, c in mine):
                want.append((e, s))
    assert got == sorted(want)
