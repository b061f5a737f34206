"""G1-G4 gap insights: presence rules and overlapping vintage windows."""

from pyspark.sql import functions as F

from cohortlens.operators import insights
from cohortlens.plans.baseline import build_baseline
from tests.conftest import cohort_df, golden_rows


def _base(spark, rows):
    return build_baseline(cohort_df(spark, rows)).table


def _rows(months, markets=("Mexico", "Brazil"), devices=("Stick", "Box")):
    out = []
    for i, m in enumerate(months):
        for j, k in enumerate(markets):
            for d, dev in enumerate(devices):
                out += golden_rows(1, cohort_month=m, market=k, device_type=dev, households=100 + 10 * i + j + d,
                                   cpm=20.0 + 3 * j + i, month_6_retention=0.5 + 0.01 * i + 0.02 * d,
                                   first_week_hours=10.0 + i + 2 * d + j, monthly_streaming_hours=100.0 + 5 * d + 7 * j)
    return out


def test_vintage_needs_four_months(spark):
    b = _base(spark, _rows(["2025-01", "2025-02", "2025-03"]))
    assert insights.vintage_trend(b).count() == 0


def test_vintage_overlapping_windows(spark):
    b = _base(spark, _rows(["2025-01", "2025-02", "2025-03", "2025-04"]))
    r = insights.vintage_trend(b).first()
    assert r.oldest_cohorts == "2025-01 – 2025-03" and r.newest_cohorts == "2025-02 – 2025-04"
    assert r.primary_driver in ("retention", "monetization", "cohort mix (market/device composition)")


def test_marginal_retention_needs_two_markets(spark):
    one = _base(spark, _rows(["2025-01", "2025-02"], markets=("Mexico",)))
    assert insights.marginal_retention(one).count() == 0
    two = _base(spark, _rows(["2025-01", "2025-02"]))
    r = insights.marginal_retention(two).first()
    assert {r.best_market, r.worst_market} <= {"Mexico", "Brazil"}
    per = {x.market: x for x in insights.marginal_retention_by_market(two).collect()}
    assert per[r.best_market].value_per_hh_per_pct >= per[r.worst_market].value_per_hh_per_pct


def test_under_monetized_and_tidy(spark):
    b = _base(spark, _rows(["2025-01", "2025-02", "2025-03", "2025-04"]))
    um = insights.under_monetized(b).collect()
    assert len(um) <= 1
    g = insights.gap_insights(b)
    assert set(g.columns) == {"insight", "metric", "value_double", "value_string"}
    assert g.where(F.col("insight") == "vintage_trend").count() == 6
