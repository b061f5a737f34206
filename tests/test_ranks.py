"""W1 exact percentile rank: golden values, equivalence of the bucketed and window paths, pandas parity."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortlens.operators import ranks


def _df(spark, values, col="x"):
    return spark.createDataFrame(pd.DataFrame({col: pd.Series(values, dtype="float64"),
                                               "rid": np.arange(len(values))}))


def _ranks(df, **kw):
    out = ranks.with_percentile_ranks(df, ["x"], ["pr"], **kw)
    return dict((r.rid, r.pr) for r in out.select("rid", "pr").collect())


def test_golden(spark):
    got = _ranks(_df(spark, [1, 2, 2, 5]))
    assert [got[i] for i in range(4)] == [0.25, 0.625, 0.625, 1.0]


def test_missing_values_not_ranked(spark):
    got = _ranks(_df(spark, [1.0, None, float("nan"), 3.0]))
    assert got[0] == 0.25 * 2 and got[3] == 1.0
    assert got[1] is None and got[2] is None


def test_negative_zero_equals_zero(spark):
    got = _ranks(_df(spark, [-0.0, 0.0, 1.0]))
    assert got[0] == got[1] == pytest.approx(0.5)


@pytest.mark.parametrize("path", ["fast", "bucketed"])
def test_paths_match_pandas_with_heavy_ties(spark, monkeypatch, path):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.integers(0, 30, 400).astype(float), np.full(300, 12.0), rng.normal(size=100)])
    if path == "bucketed":
        monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 10)
        monkeypatch.setattr(ranks, "BROADCAST_ROWS", 5)  # also exercise the shuffle-join join-back
        got = _ranks(_df(spark, vals))
    else:
        got = _ranks(_df(spark, vals), max_rows=len(vals))
    want = pd.Series(vals).rank(pct=True)
    assert np.allclose([got[i] for i in range(len(vals))], want.to_numpy(), rtol=0, atol=1e-15)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=-5, max_value=5), min_size=1, max_size=40))
def test_property_window_equals_bucketed(spark, values):
    vals = [float(v) for v in values]
    df = _df(spark, vals)
    w = dict((r.rid, r.pr) for r in ranks.percentile_rank_window(df, "x", "pr").collect())
    old = (ranks.ROWS_PER_BUCKET, ranks.BROADCAST_ROWS)
    ranks.ROWS_PER_BUCKET, ranks.BROADCAST_ROWS = 2, 3
    try:
        b = _ranks(df)
    finally:
        ranks.ROWS_PER_BUCKET, ranks.BROADCAST_ROWS = old
    assert all(abs(w[i] - b[i]) < 1e-15 for i in range(len(vals)))
    assert np.allclose([b[i] for i in range(len(vals))], pd.Series(vals).rank(pct=True).to_numpy())


def test_minmax_normalize(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "x double")
    got = sorted(r.n for r in ranks.minmax_normalize(df, "x", "n").collect())
    assert got == [0.0, 0.5, 1.0]
    const = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert {r.n for r in ranks.minmax_normalize(const, "x", "n").collect()} == {0.5}


def test_rank_plan_has_no_single_partition(spark):
    df = _df(spark, list(range(50)))
    out = ranks.with_percentile_ranks(df, ["x"], ["pr"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_long_form_join_back_matches(spark, monkeypatch):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({c: rng.normal(size=300).round(2) for c in ("a", "b", "c", "d", "e")})
    pdf["rid"] = np.arange(300)
    df = spark.createDataFrame(pdf)
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", 50)
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 40)
    cols = ["a", "b", "c", "d", "e"]
    got = ranks.with_percentile_ranks(df, cols, [f"p_{c}" for c in cols], row_id="rid").toPandas().sort_values("rid")
    for c in cols:
        assert np.allclose(got[f"p_{c}"].to_numpy(), pdf[c].rank(pct=True).to_numpy())


def test_rows_are_dealt_before_ranks_are_put_together(spark, monkeypatch):
    """The long form is dealt by row id to as many tasks as its rows ask for; none adds up ids before."""
    monkeypatch.setattr(ranks, "LONG_ROWS_PER_TASK", 100)
    n, cols = 300, ["a", "b", "c", "d"]
    df = spark.range(n).selectExpr("id AS rid", "id % 7 + 0D AS a", "IF(id % 5 = 0, NULL, id / 3D) AS b", "id * id + 0D AS c", "IF(id % 3 = 0, double('NaN'), 1D) AS d")
    found = ranks.with_percentile_ranks(df, cols, [f"{c}_pr" for c in cols], row_id="rid", rows_per_bucket=50, broadcast_rows=0)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [i for i, x in enumerate(plan) if "hashpartitioning(rid" in x]
    assert dealt and all(", 11)" in plan[i] for i in dealt)  # 300 + 240 + 300 + 200 rows
    assert not any("Aggregate" in x for x in plan[dealt[-1]:])
    got = {r.rid: tuple(r)[-4:] for r in found.collect()}
    pdf = df.toPandas()
    want = pdf[cols].rank(pct=True).to_numpy()
    for i, rid in enumerate(pdf["rid"]):
        assert [g for g in got[rid]] == [None if np.isnan(w) else pytest.approx(w, abs=1e-12) for w in want[i]]
