"""C1-C7 scenario engine: golden presets, batch == single, identity and clip edge cases, scopes."""

import pytest

from cohortlens.operators import scenario
from cohortlens.operators.scenario import Scenario, compare_scenarios
from cohortlens.operators.value import run_clv_model
from tests.conftest import cohort_df, golden_rows


@pytest.fixture(scope="module")
def base(spark):
    return run_clv_model(cohort_df(spark, golden_rows()), 0.10).withColumn(
        "engagement_segment", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("High"))


def _one(base, sc):
    return compare_scenarios(base, [sc], 0.10).first()


def test_onboarding_golden(base):
    r = _one(base, Scenario("onb", {"first_week_lift": 0.15, "app_install_lift": 0.10}, 750_000.0))
    assert r.scenario_avg_expected_retained_months == pytest.approx(12.3000863064, abs=1e-9)
    assert r.scenario_avg_clv == pytest.approx(26.1900584433, abs=1e-8)
    assert r.incremental_value == pytest.approx(1319.6842316, abs=1e-5)
    assert r.roi == pytest.approx(0.00175957898, rel=1e-8)
    assert r.verdict == "Balanced"


def test_cpm_with_risk_guardrail_golden(base):
    r = _one(base, Scenario("cpm", {"cpm_lift": 0.20, "experience_risk_penalty": 0.30}))
    assert r.scenario_mph == pytest.approx(0.04411702763, abs=1e-9)  # fixed-point means: 1e-9 resolution
    assert r.scenario_avg_expected_retained_months == pytest.approx(10.9794823460, abs=1e-9)
    assert r.scenario_avg_clv == pytest.approx(27.6118826147, abs=1e-8)
    assert r.incremental_value == pytest.approx(2741.5084029, abs=1e-5)
    assert r.month_6_retention_delta_pts == pytest.approx(-3.6, abs=1e-9)
    assert r.verdict == "Guardrail flag"
    assert r.roi is None and r.payback_months is None and r.never_pays_back is False


def test_batch_equals_single(base):
    scs = [Scenario(f"s{i}", {"trc_usage_lift": 0.05 * i, "cpm_lift": 0.02 * i, "experience_risk_penalty": 0.1},
                    100_000.0) for i in range(5)]
    batch = {r.scenario_id: r for r in compare_scenarios(base, scs, 0.10).collect()}
    for sc in scs:
        one = _one(base, sc)
        assert batch[sc.scenario_id].scenario_avg_clv == pytest.approx(one.scenario_avg_clv, abs=1e-12)
        assert batch[sc.scenario_id].incremental_value == pytest.approx(one.incremental_value, abs=1e-9)


def test_zero_levers_identity_and_not_identity(spark):
    ok = run_clv_model(cohort_df(spark, golden_rows()), 0.10)
    r = _one(ok, Scenario("zero", {}))
    assert r.incremental_value == pytest.approx(0.0, abs=1e-9)
    capped = run_clv_model(cohort_df(spark, golden_rows(1, month_1_retention=1.0, gross_margin=0.97)), 0.10)
    r2 = _one(capped, Scenario("zero", {}))
    assert r2.incremental_value < 0  # retention capped at .98 and margin at .95


def test_negative_retention_factor_floors_at_zero(spark):
    b = run_clv_model(cohort_df(spark, golden_rows()), 0.10)
    r = _one(b, Scenario("harsh", {"cpm_lift": 2.0, "sub_conversion_lift": 1.0, "experience_risk_penalty": 0.5}))
    assert r.scenario_avg_month_6_retention == 0.0
    assert r.verdict in ("Net negative", "Guardrail flag", "Neutral", "Balanced")


def test_scopes_and_empty_scope(spark):
    from pyspark.sql import functions as F
    rows = golden_rows(1) + golden_rows(1, market="Brazil", cohort_month="2025-04")
    b = run_clv_model(cohort_df(spark, rows), 0.10).withColumn("engagement_segment", F.lit("Low"))
    out = {r.scenario_id: r for r in compare_scenarios(b, [
        Scenario("mx", {"retention_lift": 0.05}, 1.0, market="Mexico"),
        Scenario("none", {"retention_lift": 0.05}, 1.0, market="Nowhere"),
        Scenario("low", {"retention_lift": 0.05}, 1.0, engagement_segment="Low"),
    ], 0.10).collect()}
    assert set(out) == {"mx", "low"}
    assert out["mx"].households == 1000 and out["low"].households == 2000


def test_cost_zero_and_negative_value(spark):
    b = run_clv_model(cohort_df(spark, golden_rows()), 0.10)
    r = _one(b, Scenario("neg", {"gross_margin_change": -0.1}, 50_000.0))
    assert r.incremental_value < 0 and r.never_pays_back is True and r.payback_months is None
    r0 = _one(b, Scenario("free", {"retention_lift": 0.01}, 0.0))
    assert r0.roi is None and r0.payback_months is None and r0.never_pays_back is False


def test_impact_and_levers(spark):
    b = run_clv_model(cohort_df(spark, golden_rows()), 0.10)
    cmp = compare_scenarios(b, scenario.PRESETS, 0.10)
    assert scenario.scenario_impact(cmp).count() == 4 * len(scenario.PRESETS)
    lv = scenario.lever_summary(scenario.scenario_table(spark, scenario.PRESETS)).collect()
    assert {(r.scenario_id, r.lever) for r in lv} == {
        ("onboarding_push", "first_week_lift"), ("onboarding_push", "app_install_lift"),
        ("engagement_push", "trc_usage_lift"), ("monetization_push", "cpm_lift"),
        ("monetization_push", "sub_conversion_lift")}
