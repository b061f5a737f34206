"""SURVEY section 5 invariants on the sf0.001 baseline: segments partition the table, households are
preserved by every rollup, scores stay in range."""

from pyspark.sql import functions as F

from cohortlens.operators import monetization as mon
from cohortlens.operators import segments, views
from cohortlens.plans.baseline import baseline_for
from tests.conftest import SF_SMALL


def test_segments_partition_and_households_invariant(spark):
    b = baseline_for(spark, SF_SMALL).table
    total = b.agg(F.sum("households")).first()[0]
    n = b.count()
    seg = {r["engagement_segment"]: r["count"] for r in b.groupBy("engagement_segment").count().collect()}
    assert set(seg) <= {"Low", "Medium", "High"} and sum(seg.values()) == n
    assert b.where(F.col("engagement_segment").isNull()).count() == 0
    dims = ["engagement_segment", "market", "device_type", "cohort_month", "region"]
    gs = segments.segment_summaries(b, dims)
    for d in dims:
        assert gs.where(F.col("dimension") == d).agg(F.sum("households")).first()[0] == total
        assert segments.segment_summary(b, d).agg(F.sum("households")).first()[0] == total
    assert mon.guardrail_summary(b).agg(F.sum("households")).first()[0] == total
    assert views.coverage(b).agg(F.sum("households")).first()[0] == total


def test_score_ranges(spark):
    b = baseline_for(spark, SF_SMALL).table
    r = b.agg(*[F.min(c).alias(f"mn_{c}") for c in ("engagement_score", "monetization_depth_score",
                                                    "experience_health_score", "balanced_value_score")],
              *[F.max(c).alias(f"mx_{c}") for c in ("engagement_score", "monetization_depth_score",
                                                    "experience_health_score", "balanced_value_score")]).first()
    assert 0 < r.mn_engagement_score and r.mx_engagement_score <= 1
    for c in ("monetization_depth_score", "experience_health_score", "balanced_value_score"):
        assert 0 <= r[f"mn_{c}"] and r[f"mx_{c}"] <= 100
