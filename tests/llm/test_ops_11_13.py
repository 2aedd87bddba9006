"""Hard negatives, the quality discriminant and periodic runs against brute force and held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_llm import EDGE, docs_of
from tests.oracle import assert_same, connect
from tideline.llm import op11_negatives as op11
from tideline.llm import op12_quality_qda as op12
from tideline.llm import op13_periodic as op13
from tideline.llm.registry import QUERIES, SQL

# ---- 11: hard negatives -------------------------------------------------------------------


def brute_negatives(rows, every, positives, negatives):
    kept = {(i, y, tuple(v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    ints = [(i, y, [int(np.floor(256 * float(x))) for x in v]) for i, y, v in kept]
    out = []
    for i, y, v in ints:
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in ints]
        best = sorted((s, j) for s, j, z in score if z == y and j != i)[:positives]
        for s, j in best:
            near = sorted((t, k) for t, k, z in score if z != y and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, every=3, kind="float", **more):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").withColumn("id", F.lit("x")).withColumn("key", F.lit("y")).withColumn("vec", F.lit(1))
    return sorted(tuple(r) for r in op11.mine(df, F.col("id") % every == 0, **more).collect())


@pytest.mark.parametrize("seed,block,width", [(0, (512, 4096), 32), (1, (2, 7), 3), (2, (1, 5), 64)])
def test_negatives_equal_brute_force(spark, seed, block, width):
    r = np.random.default_rng(seed)
    rows = [(i, int(r.integers(0, 3)), [float(np.float32(x)) for x in r.normal(0.3, 0.5, 9)]) for i in range(90)]
    rows += [(100 + i, i % 3, rows[4][2]) for i in range(30)]  # a hot vector, ties all over
    rows += [rows[3], rows[3], (6, 2, [0.25] * 9), (None, 1, [1.0] * 9), (200, None, [1.0] * 9), (201, 1, None), (202, 1, [1.0, None]), (203, 1, [float("nan")] * 9), (204, 1, [float("inf")] * 9), (205, 1, [0.5] * 4), (206, 2, [])]
    assert mined(spark, rows, positives=3, negatives=4, block=block, width=width) == brute_negatives(rows, 3, 3, 4)


def test_negatives_edges(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 0, [1.0])]) == [] and mined(spark, [(3, 0, [1.0]), (4, 0, [1.0])]) == []
    # large components leave float64, whole numbers stay exact
    r = random.Random(3)
    rows = [(i, i % 2, [r.random() * 2.0**22 for _ in range(4)]) for i in range(20)]
    assert mined(spark, rows, kind="double", every=4) == brute_negatives(rows, 4, 5, 10)
    # ids and labels that are text
    words = spark.createDataFrame([("a", "x", [1.0]), ("b", "x", [1.0]), ("c", "y", [0.5]), (None, "y", [0.5])], "vec_id string, label string, embedding array<double>")
    assert [tuple(x) for x in op11.mine(words, F.col("id") == "a").collect()] == [("a", "b", 1, "c", 65536, 32768)]


@settings(max_examples=60, deadline=None)
@given(st.integers(-(2**60), 2**60), st.integers(-(2**60), 2**60))
def test_negatives_window(p, s):
    low, high = op11.window(np.array([p]))
    assert (low[0] <= s <= high[0]) == (30 * p <= 100 * s <= 90 * p)


def test_negatives_query(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(QUERIES["op11_negatives"](spark, sf), connect(sf), SQL["op11_negatives"])


# ---- 12: quality discriminant -------------------------------------------------------------


def test_statistics_count_what_they_say():
    texts = ["Ab c!\nab C ab\n", "", None, "ß# 1,2 é", "a b c a b c a b c"]
    got = op12.statistics(pa.record_batch([pa.array(texts, pa.string())], names=["text"]))
    assert got.shape == (5, op12.STATISTICS) and np.isfinite(got).all() and (got[1] == got[2]).all()
    names = dict(enumerate(got[0]))
    assert np.isclose(names[0], np.log1p(5)) and np.isclose(names[11], np.log1p(2))
    assert np.isclose(names[2], np.arcsin(np.sqrt(2 / 8))) and np.isclose(names[5], np.arcsin(np.sqrt(1 / 9)))
    assert np.isclose(names[13], np.arcsin(np.sqrt(3 / 5))) and np.isclose(names[14], np.arcsin(np.sqrt(3 / 5)))
    assert np.isclose(got[3][4], np.arcsin(np.sqrt(1 / 6))) and np.isclose(got[3][8], np.arcsin(np.sqrt(2 / 6)))
    assert np.isclose(got[4][15], np.arcsin(np.sqrt(4 / 7)))
    # each text on its own gives the same numbers
    for t, row in zip(texts, got):
        assert np.allclose(op12.statistics(pa.record_batch([pa.array([t], pa.string())], names=["text"]))[0], row)


def test_discriminant_equals_densities(spark):
    r = np.random.default_rng(0)
    a, b = r.normal(0, 1, (400, 4)) @ r.normal(0, 1, (4, 4)), r.normal(0.7, 2, (900, 4))
    rows = spark.createDataFrame([(0, x.tolist()) for x in a] + [(1, x.tolist()) for x in b], "y int, x array<double>").repartition(5)
    m = op12.fit(rows, ridge=0.0)
    # brute force: weights of the rule from all products, densities from inverse and determinant
    cov = [np.cov(v.T, bias=True) for v in (a, b)]
    pooled = (400 * cov[0] + 900 * cov[1]) / 1300
    s = np.sqrt(np.diag(pooled))
    out = []
    for v, c in ((a, cov[0]), (b, cov[1])):
        z, c, t = (v - v.mean(0)) / s, c / np.outer(s, s), pooled / np.outer(s, s)
        w = min(1, np.mean([((np.outer(x, x) - c) ** 2).sum() for x in z]) / len(v) / ((c - t) ** 2).sum())
        k = (1 - w) * c + w * t
        d = (np.vstack([a, b]) - v.mean(0)) / s
        out.append(np.log((len(v) + 1) / 1302) - 0.5 * np.log(np.linalg.det(k)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(k), d))
    assert np.allclose(m.margin(np.vstack([a, b])), out[1] - out[0])


def test_discriminant_edges(spark):
    d = docs_of(spark, EDGE).withColumn("x", F.lit(1)).withColumn("y", F.lit("z")).withColumn("score", F.lit(0))
    x = op12.describe(d)
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    score = lambda rows: [r.score for r in op12.score(x, op12.fit(op12.labelled(x, label(rows)))).orderBy("doc_id").collect()]
    assert set(score([])) == {0.5} and set(score([(1, None, 0), (2, 7, 0), (None, 1, 0)])) == {0.5}
    assert score([(7, 1, 0), (5, 1, 0)]) == pytest.approx([0.75] * len(EDGE))
    assert score([(7, 1, 0), (7, 0, 1), (5, 1, 0), (5, 1, 1)]) == pytest.approx([2 / 3] * len(EDGE))  # one has both labels, one has its label twice
    both = score([(7, 0, 0), (5, 1, 0), (6, 1, 0)])
    assert all(0 <= s <= 1 for s in both) and both[0] == both[1] and both[8] == both[9] and both[7] < 0.5 < both[5]
    nulls = spark.createDataFrame([(None, "a b"), ("k", None)], "doc_id string, text string")
    assert op12.score(op12.describe(nulls), op12.Discriminant(0.5)).count() == 2 and op12.describe(d.limit(0)).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op12_quality_qda"](spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    known = got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert len(known) > 100 and (known.predicted == known.quality).mean() > 0.97
    good, bad = known[known.quality == 1].score.to_numpy(), known[known.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.99


# ---- 13: periodic runs --------------------------------------------------------------------


def brute_runs(w, least=6, times=4):
    n, got = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                got.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in got.items())


def of(lists):
    flat = np.array([x for w in lists for x in w], np.int64)
    return op13.runs_of(flat, np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int64))


#: Texts of few words with repeated parts, and parts of them again.
PARTS = st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=7), st.integers(1, 9)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PARTS, st.booleans()), min_size=1, max_size=4))
def test_runs_equal_brute_force(texts):
    lists = []
    for parts, twice in texts:
        w = [x for u, n in parts for x in u * n]
        lists.append(w + w[len(w) // 3 :] if twice else w)
    assert of(lists) == [brute_runs(w) for w in lists]


def test_runs_random():
    r = random.Random(7)
    for _ in range(300):
        w = [r.randrange(2) for _ in range(r.randint(0, 120))]
        assert of([w, w]) == [brute_runs(w)] * 2
    assert of([[1] * 3000, [], [2] * 5, [1, 2] * 3, list(range(400)) * 5]) == [[(0, 3000, 1)], [], [], [], [(0, 2000, 400)]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4))
def test_suffix_array_and_previous_factors(lists):
    flat, bounds = [x for w in lists for x in w], np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int64)
    s = op13.Suffixes(np.array(flat, np.int64), bounds)
    assert s.array.tolist() == [int(bounds[k]) + i for k, w in enumerate(lists) for i in sorted(range(len(w)), key=lambda i: w[i:])]
    factor, source = s.previous()
    for k, w in enumerate(lists):
        for i in range(len(w)):
            best = max((next((n for n in range(len(w) - i) if w[i + n] != w[j + n]), len(w) - i) for j in range(i)), default=0)
            at = int(bounds[k]) + i
            assert factor[at] == best and (not best or flat[source[at] : source[at] + best] == flat[at : at + best])


def test_periodic_query(spark, sf_dir):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    for r, t in zip(QUERIES["op13_periodic"](spark, sf_dir).orderBy("doc_id").collect(), pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id").text):
        w = word.findall(t or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        # a necessary sign keeps brute force away from long plain texts
        runs = brute_runs(w) if h % 10 == 0 or n <= 400 else None
        if runs is None:
            continue
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3)) and r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def test_periodic_edges(spark):
    d = docs_of(spark, [*EDGE, "x a b a b a b a b y", "Ä " * 9 + "end"])
    got = op13.periodic(d).orderBy("doc_id").collect()
    assert [r.collapsed for r in got][-2:] == ["x a b y", "Ä end"] and [len(r.runs) for r in got] == [0] * 7 + [1, 0, 0, 0, 1, 1] and got[0].collapsed == ""
    kept = op13.collapse(d)
    assert kept.columns == d.columns and [r.text for r in kept.orderBy("doc_id").collect()][:8] == [*EDGE[:7], "word"]
    assert op13.periodic(d.limit(0)).count() == 0 and op13.collapse(d.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a " * 8), ("k", None), ("k", None)], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.collapsed) for r in op13.periodic(nulls, op13.looped, F.lit(3)).collect()) == [("", "a"), ("k", ""), ("k", "")]
