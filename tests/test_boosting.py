"""Boosted trees: many fits in one, attributions against coalitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import boosting as B


def plain_fit(x, y, edges, trees, depth, rate):
    """One fit as it is told, row by row of each node."""
    share = min(1 - 1e-6, max(1e-6, y.mean()))
    start = math.log(share / (1 - share))
    b = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    m = np.full(len(y), start)

    def grow(rows, level):
        p = 1 / (1 + np.exp(-m[rows]))
        g, h = y[rows] - p, p * (1 - p)
        best = (1e-9, None, None)
        if level < depth:
            for f in range(x.shape[1]):
                for e in range(len(edges[f])):
                    low = b[rows, f] <= e
                    if low.any() and not low.all():
                        gain = round(g[low].sum() ** 2 / low.sum() + g[~low].sum() ** 2 / (~low).sum() - g.sum() ** 2 / len(g), 9)
                        if gain > best[0]:
                            best = (gain, f, e)
        if best[1] is None:
            return {tuple(rows.tolist()): rate * g.sum() / h.sum()}
        low = b[rows, best[1]] <= best[2]
        return grow(rows[low], level + 1) | grow(rows[~low], level + 1)

    for _ in range(trees):
        for rows, v in grow(np.arange(len(y)), 0).items():
            m[list(rows)] += v
    return m


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(5)
    x = np.column_stack([r.normal(size=300), r.integers(0, 3, 300), r.normal(size=300), np.zeros(300)]).round(3)
    y = ((x[:, 0] + (x[:, 1] == 1) - 0.5 * x[:, 2] * x[:, 0] + r.normal(0, 0.3, 300)) > 0.3).astype(float)
    return x, y


COLUMNS = ["a", "b", "c", "d"]


@pytest.mark.parametrize("direct", [64, 0])
def test_many_fits_equal_single_ones(spark, data, monkeypatch, direct):
    x, y = data
    monkeypatch.setattr(B, "SAVE", 3)
    monkeypatch.setattr(B, "DIRECT", direct)
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(300)] + [(999, 1.0, 1.0, 1.0, 1.0, None)], "id long, a double, b double, c double, d double, y int").repartition(3)
    models = B.fit(df, COLUMNS, "y", [F.lit(True), F.col("id") % 3 != 0, F.col("id") < 0], trees=7, depth=3, rate=0.3)
    for model, use in zip(models, (np.ones(300, bool), np.arange(300) % 3 != 0)):
        want = plain_fit(x[use], y[use], model.edges, 7, 3, 0.3)
        assert np.allclose(model.margin(x[use]), want)
    assert np.allclose(models[2].margin(x), models[2].start) and models[0].gains()[0][0] in COLUMNS
    got = {r.id: r.m for r in B.margins(df, {"m": models[0]}).collect()}
    assert len(got) == 301 and np.allclose([got[i] for i in range(300)], models[0].margin(x))
    slope, shift = B.platt(B.margins(df.where("y is not null"), {"m": models[0]}), "m", "y")
    assert slope > 0 and abs(sum(1 / (1 + np.exp(-(slope * got[i] + shift))) for i in range(300)) - y.sum()) < 0.5


@pytest.mark.parametrize("least,direct,codes", [(1, 64, 1024), (10_000, 0, 1024), (1, 0, 8)])
def test_dealt_fits_of_copied_rows_equal_single_ones(spark, data, monkeypatch, least, direct, codes):
    """Rows with the same bins are kept once, in blocks of one set of fits or of several."""
    x, y = data
    for name, value in (("SAVE", 3), ("DIRECT", direct), ("WHOLE_ROWS", 0), ("LEAST_ROWS", least), ("BLOCK_ROWS", 50), ("CODES", codes)):
        monkeypatch.setattr(B, name, value)
    times = np.arange(300) % 4 + 1
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(300) for _ in range(times[i])], "id long, a double, b double, c double, d double, y int").repartition(3)
    models = B.fit(df, COLUMNS, "y", [F.lit(True), F.col("id") % 3 != 0, F.col("id") % 5 == 0, F.col("id") < 0], trees=7, depth=3, rate=0.3)
    every = np.repeat(np.arange(300), times)
    for model, use in zip(models, (every >= 0, every % 3 != 0, every % 5 == 0)):
        rows = every[use]
        assert np.allclose(model.margin(x[rows]), plain_fit(x[rows], y[rows], model.edges, 7, 3, 0.3))
        assert all(t.cover[0] == len(rows) for t in model.trees)
    assert np.allclose(models[3].margin(x), models[3].start)


def test_few_different_rows_take_few_jobs(spark, monkeypatch):
    """However many trees there are and however often a row occurs."""
    saved, real = [], B.Workspace.save
    monkeypatch.setattr(B.Workspace, "save", lambda self, df: saved.append(real(self, df)) or saved[-1])
    df = spark.range(30_000).select((F.col("id") % 30).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 3 == 0).cast("int").alias("y"))

    def jobs(trees):
        group = f"boosting-{trees}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            B.fit(df, ["a", "b"], "y", [F.lit(True), F.col("a") < 20], trees=trees)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(12) < 20
    assert saved[-1].agg(F.sum("n"), F.sum("size")).first()[:] == (30_000, 210)


def test_margins_only_where_they_are_asked_for(spark, data, monkeypatch):
    """Whatever batches the rows come in."""
    x, y = data
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(300)], "id long, a double, b double, c double, d double, y int")
    one, two = B.fit(df, COLUMNS, "y", [F.lit(True), F.col("id") % 2 == 0], trees=3, rate=0.3)
    monkeypatch.setattr(B, "BATCH_ROWS", 100)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        scored = B.margins(df, {"p": one, "q": two, "r": two}, {"q": F.col("id") % 3 == 0, "r": F.lit(None).cast("boolean")})
        got = {r.id: (r.p, r.q, r.r) for r in scored.collect()}
        curves = B.platts(scored, ["p", "q", "r"], "y")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert scored.columns == [*df.columns, "p", "q", "r"] and len(got) == 300
    p, q = one.margin(x), two.margin(x)
    assert all(math.isclose(got[i][0], p[i]) and got[i][2] is None and (math.isclose(got[i][1], q[i]) if i % 3 == 0 else got[i][1] is None) for i in range(300))
    assert np.allclose(curves[:2], [B.platt(scored, "p", "y"), B.platt(scored.where("q is not null"), "q", "y")]) and curves[2] == (1.0, 0.0)


def conditional(t, b, known, i=0):
    """The tree's value where features outside ``known`` follow the rows' shares."""
    f = t.feature[i]
    if f < 0:
        return t.value[i]
    low, high = 2 * i + 1, 2 * i + 2
    if f in known:
        return conditional(t, b, known, low if b[f] <= t.edge[i] else high)
    return (t.cover[low] * conditional(t, b, known, low) + t.cover[high] * conditional(t, b, known, high)) / t.cover[i]


def test_attributions_equal_coalitions(spark, data):
    x, y = data
    df = spark.createDataFrame([(*map(float, x[i]), int(y[i])) for i in range(300)], "a double, b double, c double, d double, y int")
    (m,) = B.fit(df, COLUMNS, "y", [F.lit(True)], trees=6, depth=4, rate=0.3)
    phi, base = m.attributions(x[:40])
    assert np.allclose(phi.sum(axis=1), m.margin(x[:40]) - base)
    for row, b in zip(phi, m.bins(x[:40])):
        value = lambda s: sum(conditional(t, b, s) for t in m.trees)
        for u in range(4):
            others = [j for j in range(4) if j != u]
            want = sum(math.factorial(n) * math.factorial(3 - n) / math.factorial(4) * (value({*s, u}) - value(set(s))) for n in range(4) for s in itertools.combinations(others, n))
            assert math.isclose(row[u], want, abs_tol=1e-9)
    got = B.attributed(df.withColumn("id", F.monotonically_increasing_id()), m, ["id"]).first()
    assert math.isclose(sum(got[f"phi_{c}"] for c in COLUMNS), got["margin"] - got["base"], abs_tol=1e-9)
