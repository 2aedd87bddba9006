"""Cases that turn up in larger tables only."""

import datetime

import pytest
from pyspark.sql import functions as F

from tests.oracle import TABLES, assert_same
from tideline import plans

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
AT = datetime.datetime(2024, 1, 9)


def given(spark, tmp_path, sf_dir, **tables):
    """A folder with these tables and a connection to them and the others."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f'{tmp_path}/{name}.parquet/*.parquet' if name in tables else f'{sf_dir}/{name}.parquet'}'")
    return str(tmp_path), con


def test_windows_go_by_the_nearest_second(spark, tmp_path, sf_dir):
    micros = [-1_500_001, -1_500_000, -500_001, -500_000, -499_999, -1, 0, 1, 499_999, 500_000, 500_001]
    rows = [(i, AT + datetime.timedelta(hours=6, microseconds=m), 3, t, 50.0 + i, f'{{"k": {7 * i % 100}}}') for i, (m, t) in enumerate((m, t) for m in micros for t in ("view", "click", "signup", "purchase", "error"))]
    path, con = given(spark, tmp_path, sf_dir, events=spark.createDataFrame(rows, EVENT))
    assert_same(plans.QUERIES["fusion_features_24h"](spark, path), con, plans.SQL["fusion_features_24h"])


def test_money_is_rounded_as_in_sql(spark, tmp_path, sf_dir):
    """Halves of a dollar and of a tenth of a percent."""
    prices = [300.0 * m for m in range(1, 1667)] + [m + 0.5 for m in range(1000, 1100)] + [2100.01, 0.5, 1234567.5, None]
    rows = spark.createDataFrame(list(enumerate(prices)), "o_orderkey long, o_totalprice double")
    path, con = given(spark, tmp_path, sf_dir, orders=rows)
    assert_same(plans.QUERIES["money_text"](spark, path), con, plans.SQL["money_text"])


def test_positions_with_a_value_of_zero(spark, tmp_path, sf_dir):
    rows = [(i, AT, i % 7, "view", v, p) for i, (v, p) in enumerate([(v, f'{{"k": {k}}}') for v in (0.0, -10.0, 5.0, None) for k in range(100)] + [(1.0, "{}")])] + [(999, AT, None, "view", 1.0, '{"k": 1}')]
    path, con = given(spark, tmp_path, sf_dir, events=spark.createDataFrame(rows, EVENT))
    assert_same(plans.QUERIES["valid_positions"](spark, path), con, plans.SQL["valid_positions"])


@pytest.mark.parametrize("name", ["asof_interpolate", "pending_expired"])
def test_no_frame_reaches_to_the_end_of_a_window(spark, sf_dir, name):
    """Spark sums such a frame up anew for every row, so a chunk would take the square of its rows."""
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString().lower()
    assert "specifiedwindowframe" in plan and "unboundedfollowing" not in plan


@pytest.mark.parametrize("size", [3, 100])
def test_carried_marks_equal_plain_search(spark, size):
    from tideline.operators.signals import carried

    rows = [(e, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h), h, m) for e in (1, 2) for h, m in enumerate([None, None, 1, None, 2, None, None, None, 3, 4, None] if e == 1 else [None] * 7)]
    df = spark.createDataFrame(rows, "e int, t timestamp, i int, m int")
    got = {(r.e, r.i): (r.before and r.before.m, r.after and r.after.m) for r in carried(df, "e", "t", "i", F.when(F.col("m").isNotNull(), F.struct("m")), size).collect()}
    of = lambda e: [r for r in rows if r[0] == e]
    assert got == {(e, i): (next((m for *_, j, m in reversed(of(e)) if m and j <= i), None), next((m for *_, j, m in of(e) if m and j > i), None)) for e, _, i, _ in rows}


def test_boosting_deals_rows_over_all_cores(spark, monkeypatch):
    """However few files the rows come in."""
    from tideline.operators import boosting

    saved, real = [], boosting.Workspace.save
    monkeypatch.setattr(boosting.Workspace, "save", lambda self, df: saved.append(real(self, df)) or saved[-1])
    df = spark.range(20_000, numPartitions=1).select((F.col("id") % 101 / 7).alias("a"), (F.col("id") % 13).cast("double").alias("b"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    (m,) = boosting.fit(df, ["a", "b"], "y", [F.lit(True)], trees=2)
    assert saved[-1].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and saved[-1].agg(F.sum("n")).first()[0] == 20_000
    assert all(t.cover[0] == 20_000 and t.cover[1] + t.cover[2] == 20_000 for t in m.trees)


def test_leaves_by_columns_equal_walks(spark):
    """Also in trees with leaves at any depth."""
    import numpy as np

    from tideline.operators.boosting import Tree

    r = np.random.default_rng(1)
    for _ in range(20):
        t, b = Tree(4), r.integers(0, 6, (3, 50)).astype(np.uint8)
        t.value[:] = r.normal(size=31)
        for i in range(15):
            if (i == 0 or t.feature[(i - 1) // 2] >= 0) and r.random() < 0.8:
                t.feature[i], t.edge[i] = r.integers(0, 3), r.integers(0, 5)
        want = []
        for x in b.T:
            i = 0
            while t.feature[i] >= 0:
                i = 2 * i + 1 + (x[t.feature[i]] > t.edge[i])
            want.append(t.value[i])
        assert t.values(b).tolist() == want


def test_stored_pages_hold_few_rows(tmp_path):
    """One file of 80 MB in one row group."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tideline.sources.feeds import stored_pages

    n = 20_000
    bodies = [os.urandom(2000).hex() for _ in range(n)]
    pq.write_table(pa.table({"keyword": ["k1" if i % 2 else "k2" for i in range(n)], "shown": pa.array([i % 20 for i in range(n)], pa.int32()), "id": [f"d{i}" for i in range(n)], "title": ["t"] * n, "body": bodies, "published": pa.array([0] * n, pa.timestamp("us"))}), f"{tmp_path}/a.parquet", row_group_size=n, use_dictionary=["keyword"])
    del bodies
    start, most, seen = pa.total_allocated_bytes(), 0, 0
    for row in stored_pages("k1", 9, {"path": str(tmp_path)}):
        seen += 1
        most = max(most, pa.total_allocated_bytes() - start)
    assert seen == n // 2 // 2 and most < 30 << 20


@pytest.mark.parametrize("name", ["stream_flushes", "stream_vessels"])
def test_no_python_call_holds_a_key(spark, tmp_path, sf_dir, monkeypatch, name):
    """However many rows a key has; also with missing values and vessels without a number, and copies where SQL orders them."""
    from tideline.streaming import jobs

    plans_run, real = [], jobs.run_available
    monkeypatch.setattr(jobs, "run_available", lambda df, *a: plans_run.append(df._jdf.queryExecution().logical().toString()) or real(df, *a))
    at = lambda i: datetime.datetime(2024, 1, 13) + datetime.timedelta(minutes=17 * i + (1500 if i > 90 else 0))
    rows = [(i, at(i), None if i % 11 == 10 else 3 + (i % 3 == 1), "view", None if i % 5 == 2 else 7.0 * i % 90, "{}" if i % 13 == 4 else f'{{"k": {7 * i % 100}}}') for i in range(260)]
    copies = rows[20:40] if name == "stream_flushes" else []
    path, con = given(spark, tmp_path, sf_dir, events=spark.createDataFrame(rows + copies, EVENT).repartition(3))
    got = plans.QUERIES[name](spark, path)
    assert len(plans_run) == 2 and not any("TransformWithState" in p or "InPandas" in p for p in plans_run)
    assert_same(got, con, plans.SQL[name])
