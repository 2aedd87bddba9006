import pytest

from tests.oracle import assert_same, connect
from tideline import plans

SLOW = {"gbt_loco", "gbt_attributions", "feature_attributions", "surrogate"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert_same(plans.QUERIES[name](spark, sf_dir), con, plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL) - SLOW))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["price_changepoint", "price_regime", "war_risk_premium", "ais_gaps", "tone_delta", "tick_features", "roc_youden"])
def test_series_equal_sql_at_a_larger_size(spark, name):
    """The size of the timings: there prices of zero occur."""
    sf = "/root/testdata/sf0.1"
    assert_same(plans.QUERIES[name](spark, sf), connect(sf), plans.SQL[name])


def test_boosted_queries_with_few_trees(spark, sf_dir, monkeypatch):
    """The registered queries with 3 trees instead of 200; the trees themselves are tested in test_boosting."""
    from tideline.operators import boosting, fusion
    from tideline.plans.ml import STREAMS

    real = boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda rows, columns, label, parts, trees=200, depth=4, rate=0.05, bins=64: real(rows, columns, label, parts, 3, depth, rate, bins))
    n = plans.QUERIES["fusion_features_batch"](spark, sf_dir).count()
    got = plans.QUERIES["feature_attributions"](spark, sf_dir).collect()
    assert len(got) == n and all(abs(sum(r[f"phi_{c}"] for c in fusion.FEATURES) - (r.margin - r.base)) < 1e-4 for r in got)
    assert all(abs(r[s] - sum(r[f"phi_{c}"] for c in columns)) < 1e-4 for r in got for s, columns in STREAMS.items())
    got = plans.QUERIES["gbt_attributions"](spark, sf_dir).collect()
    assert len(got) == n and all(abs(sum(r[s] for s in STREAMS) - (r.score - r.base)) < 1e-4 for r in got)
    got = plans.QUERIES["gbt_loco"](spark, sf_dir).collect()
    assert len(got) == n - len({r.entity for r in got}) and all(0 <= r.probability <= 1 and r.y in (0, 1) and r.crisis == r.entity % 3 for r in got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
