"""Golden row (FIXTURES section 4) through the CLV model, payback and unit economics."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.survival import survival_terms
from cohortlens.operators import value
from tests.conftest import cohort_df, golden_rows

S_GOLD = [0.72, 0.69455, 0.67, 0.645803, 0.622481, 0.60, 0.578095, 0.556991, 0.536656, 0.517064, 0.498188, 0.48,
          0.462476, 0.445593, 0.429325, 0.413651, 0.39855, 0.384, 0.369981, 0.356474, 0.34346, 0.330921, 0.31884,
          0.3072]


@pytest.fixture(scope="module")
def golden(spark):
    return value.run_clv_model(cohort_df(spark, golden_rows()), 0.10).first()


def test_revenue_and_profit(golden):
    assert golden.ad_revenue_per_household == pytest.approx(4.666368, abs=1e-9)
    assert golden.subscription_revenue_per_household == pytest.approx(0.55944, abs=1e-12)
    assert golden.total_monthly_revenue_per_household == pytest.approx(5.225808, abs=1e-9)
    assert golden.gross_profit_per_household == pytest.approx(2.3241944, abs=1e-9)


def test_survival_curve(spark):
    df = cohort_df(spark, golden_rows())
    s = survival_terms(F.col("month_1_retention"), F.col("month_3_retention"), F.col("month_6_retention"),
                       F.col("month_12_retention"))
    row = df.select(*[x.alias(f"s{i}") for i, x in enumerate(s)]).first()
    for got, want in zip(row, S_GOLD):
        assert got == pytest.approx(want, abs=5e-7)


def test_clv(golden):
    assert golden.expected_retained_months == pytest.approx(11.6803003681, abs=1e-9)
    assert golden.baseline_clv == pytest.approx(27.1472887059, abs=1e-9)
    assert golden.discounted_clv == pytest.approx(24.8703742117, abs=1e-9)
    assert golden.total_lifecycle_value == pytest.approx(24870.3742117, abs=1e-6)


def test_survival_bounds_and_clips(spark):
    rows = golden_rows(1, month_1_retention=0.0, month_3_retention=0.0, month_6_retention=0.0, month_12_retention=0.0)
    rows += golden_rows(1, month_1_retention=1.0, month_3_retention=1.0, month_6_retention=0.2, month_12_retention=0.9)
    rows += golden_rows(1, month_6_retention=0.9, month_12_retention=0.01)
    df = cohort_df(spark, rows)
    s = survival_terms(F.col("month_1_retention"), F.col("month_3_retention"), F.col("month_6_retention"),
                       F.col("month_12_retention"))
    for r in df.select(*s).collect():
        assert all(0.0 <= v <= 1.0 for v in r)
    r1 = df.select(*s).collect()[1]
    # decay clipped to 1 when m12 > m6: flat tail
    assert r1[12] == pytest.approx(r1[11])
    r2 = df.select(*s).collect()[2]
    # decay clipped to 0.5 from month 13
    assert r2[12] == pytest.approx(0.01 * 0.5)


def test_payback(spark):
    clv = value.run_clv_model(cohort_df(spark, golden_rows()), 0.10)
    assert value.payback_month(clv, 8.0).first().payback_month == 6
    assert value.payback_month(clv, 0.0).first().payback_month == 0
    assert value.payback_month(clv, 1000.0).first().payback_month is None


def test_payback_monotone_in_cac(spark):
    clv = value.run_clv_model(cohort_df(spark, golden_rows()), 0.10)
    months = [value.payback_month(clv, c).first().payback_month for c in (0.5, 2, 4, 8, 12, 16, 20, 24)]
    finite = [m for m in months if m is not None]
    assert finite == sorted(finite)


def test_payback_cross_then_fall(spark):
    # a profitable short-lived cohort and a loss-making long-lived one: cumulative profit
    # crosses CAC early and falls back below by month 24 -> None (last month is tested first)
    rich = dict(golden_rows()[0], cpm=200.0, month_1_retention=0.9, month_3_retention=0.3, month_6_retention=0.05,
                month_12_retention=0.0001, households=1000)
    poor = dict(golden_rows()[0], cpm=1.0, subscription_arpu=0.0, support_cost_per_household=3.0,
                month_1_retention=1.0, month_3_retention=1.0, month_6_retention=1.0, month_12_retention=1.0,
                households=400, cohort_month="2025-04")
    clv = value.run_clv_model(cohort_df(spark, [rich, poor]), 0.10)
    r = value.payback_month(clv, 10.0).first()
    assert r.payback_month is None


def test_unit_economics_and_empty_weight(spark):
    clv = value.run_clv_model(cohort_df(spark, golden_rows()), 0.10)
    k = value.portfolio_kpis(clv, acquisition_cost=8.0).first()
    assert k.net_clv == pytest.approx(24.8703742117 - 8.0, abs=1e-9)
    assert k.clv_to_cac == pytest.approx(24.8703742117 / 8.0, abs=1e-9)
    assert k.underwater is False
    k0 = value.portfolio_kpis(clv, acquisition_cost=0.0).first()
    assert k0.clv_to_cac is None
    zero = value.run_clv_model(cohort_df(spark, golden_rows(2, households=0)), 0.10)
    assert value.portfolio_kpis(zero).count() == 0
    assert value.payback_month(zero, 8.0).first().payback_month is None


def test_monetization_per_hour(spark):
    from cohortlens.operators.monetization import add_ratio_metrics
    r = add_ratio_metrics(value.run_clv_model(cohort_df(spark, golden_rows()), 0.10)).first()
    assert r.monetization_per_streaming_hour == pytest.approx(0.0373272, abs=1e-9)
