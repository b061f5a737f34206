"""A7/A8/A12 views: exact-threshold gaps, missing segments, coverage naming."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import monetization as mon
from cohortlens.operators import views


def _scored(spark, rows):
    schema = ("market string, device_type string, engagement_segment string, households long, "
              "monetization_depth_score double, experience_health_score double, balanced_value_score double, "
              "discounted_clv double, month_6_retention double")
    df = spark.createDataFrame(rows, schema)
    for c in ("revenue_per_household", "monetization_per_streaming_hour", "first_week_hours", "trc_usage_rate",
              "subscription_conversion_rate", "total_monthly_revenue_per_household", "cohort_month", "region"):
        df = df.withColumn(c, F.lit(1.0) if c not in ("cohort_month", "region") else F.lit("x"))
    return df


def test_gap_exactly_five_is_excluded(spark):
    rows = [("A", "d", "High", 10, 50.0, 55.0, 60.0, 5.0, 0.5),   # gap +5.0 -> not under-monetized
            ("B", "d", "Low", 10, 50.0, 45.0, 40.0, 4.0, 0.4),    # gap -5.0 -> not experience risk
            ("C", "d", "Medium", 10, 40.0, 45.2, 50.0, 4.5, 0.45)]  # gap +5.2 -> listed
    g = mon.guardrail_segments(_scored(spark, rows)).collect()
    under = [r.segment for r in g if r.list == "under_monetized"]
    risk = [r.segment for r in g if r.list == "experience_risk"]
    assert under == ["C · d"] and risk == []
    k = mon.portfolio_monetization_kpis(_scored(spark, rows)).first()
    assert k.top_under_monetized == "C · d" and k.top_experience_risk == "None flagged"


def test_headline_gaps_missing_segment_is_null(spark):
    rows = [("A", "d", "High", 10, 50.0, 55.0, 60.0, 5.0, 0.5), ("B", "d", "Medium", 10, 50.0, 45.0, 40.0, 4.0, 0.4)]
    h = {r.metric: r for r in views.headline_gaps(_scored(spark, rows)).collect()}
    assert h["high_vs_low_clv_premium"].value is None and h["high_vs_low_m6_gap_pts"].value is None
    assert h["top_market_value_share"].label == "A"
    assert h["top_market_value_share"].value == pytest.approx(50.0 / 90.0)


def test_coverage_is_unweighted(spark):
    rows = [("A", "d", "High", 1, 50.0, 55.0, 60.0, 10.0, 0.5), ("A", "e", "Low", 99, 50.0, 45.0, 40.0, 0.0, 0.3)]
    c = views.coverage(_scored(spark, rows)).first()
    assert c.avg_clv_unweighted == 5.0 and c.avg_m6_retention_unweighted == 0.4 and c.households == 100


def test_empty_scope_stops(spark):
    rows = [("A", "d", "High", 10, 50.0, 55.0, 60.0, 5.0, 0.5)]
    df = _scored(spark, rows)
    assert views.require_rows(views.scope(df, market="A")).count() == 1
    with pytest.raises(ValueError):
        views.require_rows(views.scope(df, market="A", device="zzz"))
    assert views.filter_cohorts(df, markets=[], segments=["High"]).count() == 1
