"""P13-P17 monetization ratios, W5-W7 scores, A6-A8 summaries and guardrail lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.cache import per_context
from cohortlens.functions.numeric import clip, exact_sum, rint_round, safe_div, weighted_mean
from cohortlens.schema import SEGMENT_SEPARATOR

# ---- fixed values: score weights (column, weight) ---------------------------
DEPTH_WEIGHTS = [
    ("revenue_per_household", 0.35),
    ("monetization_per_streaming_hour", 0.25),
    ("subscription_conversion_rate", 0.20),
    ("ad_supported_share", 0.10),
    ("fill_rate", 0.10),
]
HEALTH_WEIGHTS = [
    ("month_6_retention", 0.25),
    ("month_12_retention", 0.20),
    ("monthly_streaming_hours", 0.20),
    ("first_week_hours", 0.15),
    ("first_week_app_installs", 0.10),
    ("month_1_retention", 0.10),
]
BALANCED_CLV_WEIGHT = 0.40
BALANCED_DEPTH_WEIGHT = 0.30
BALANCED_HEALTH_WEIGHT = 0.30
RETENTION_RISK_POINTS = 15.0
GAP_THRESHOLD = 5.0
GUARDRAIL_TOP_N = 5


def add_ratio_metrics(df: DataFrame) -> DataFrame:
    """P13-P16 plain ratios."""
    rev = F.col("total_monthly_revenue_per_household")
    out = df.withColumns({
        "revenue_per_household": rev,
        "monetization_per_streaming_hour": rev / F.greatest(F.col("monthly_streaming_hours"), F.lit(1e-9)),
        "ad_revenue_share": F.col("ad_revenue_per_household") / F.greatest(rev, F.lit(1e-9)),
    })
    return out.withColumn("subscription_revenue_share", F.lit(1.0) - F.col("ad_revenue_share"))


def segment_key(market="market", device="device_type") -> F.Column:
    """P17 - ``market · device``."""
    return F.concat_ws(SEGMENT_SEPARATOR, F.col(market), F.col(device))


def _pct100(pr_col: str) -> F.Column:
    return F.lit(100.0) * F.col(pr_col)


def _blend(weights, pr_of) -> F.Column:
    out = None
    for c, w in weights:
        term = F.lit(w) * _pct100(pr_of(c))
        out = term if out is None else out + term
    return out


def score_columns(pr_of) -> dict[str, F.Column]:
    """W5 depth, W6 health (rounded 1 dp); W7 uses the rounded depth/health."""
    return {
        "monetization_depth_score": rint_round(_blend(DEPTH_WEIGHTS, pr_of), 1),
        "experience_health_score": rint_round(_blend(HEALTH_WEIGHTS, pr_of), 1),
    }


def balanced_column(pr_of) -> F.Column:
    risk = (F.lit(100.0) - _pct100(pr_of("month_6_retention"))) / F.lit(100.0)
    raw = (F.lit(BALANCED_CLV_WEIGHT) * _pct100(pr_of("discounted_clv"))
           + F.lit(BALANCED_DEPTH_WEIGHT) * F.col("monetization_depth_score")
           + F.lit(BALANCED_HEALTH_WEIGHT) * F.col("experience_health_score")
           - F.lit(RETENTION_RISK_POINTS) * risk)
    return rint_round(clip(raw, 0.0, 100.0), 1)


MONETIZATION_SUMMARY = [
    ("revenue_per_household", "revenue_per_household"),
    ("monetization_per_streaming_hour", "monetization_per_streaming_hour"),
    ("monetization_depth_score", "monetization_depth_score"),
    ("experience_health_score", "experience_health_score"),
    ("balanced_value_score", "balanced_value_score"),
    ("avg_clv", "discounted_clv"),
    ("avg_month_6_retention", "month_6_retention"),
]


@per_context
def monetization_aggs() -> list[F.Column]:
    return [F.sum("households").alias("households")] + [weighted_mean(src).alias(n) for n, src in MONETIZATION_SUMMARY]


def monetization_summary(df: DataFrame, by: str) -> DataFrame:
    """A6 - weighted monetization/experience summary by a dimension, balanced desc."""
    return df.groupBy(by).agg(*monetization_aggs()).orderBy(F.desc("balanced_value_score"), F.asc(by))


def guardrail_summary(df: DataFrame) -> DataFrame:
    """A6 at market x device grain with the health-depth gap (plus the weighted sums behind it)."""
    seg = df.withColumn("segment", segment_key())
    w = F.col("households")
    sums = [exact_sum(src, w).alias(f"_sx_{n}") for n, src in MONETIZATION_SUMMARY]
    s = seg.groupBy("segment").agg(F.sum(w).alias("households"), *sums)
    s = s.withColumns({n: safe_div(f"_sx_{n}", "households") for n, _ in MONETIZATION_SUMMARY})
    return s.withColumn("gap", F.col("experience_health_score") - F.col("monetization_depth_score"))


def guardrail_segments(df: DataFrame, top_n: int = GUARDRAIL_TOP_N) -> DataFrame:
    """A7 - the three planning lists in one tidy table ``(list, position, segment, ..., list_gap)``.

    Selection is on the gap; ordering is by the gap rounded to 1 dp with ties
    broken by segment name. Each list is a TakeOrdered of ``top_n`` rows.
    """
    s = guardrail_summary(df)
    under = (s.where(F.col("gap") > GAP_THRESHOLD).withColumn("list_gap", rint_round(F.col("gap"), 1))
             .orderBy(F.desc("list_gap"), F.asc("segment")).limit(top_n).withColumn("list", F.lit("under_monetized")))
    risk = (s.where(F.col("gap") < -GAP_THRESHOLD).withColumn("list_gap", rint_round(-F.col("gap"), 1))
            .orderBy(F.desc("list_gap"), F.asc("segment")).limit(top_n).withColumn("list", F.lit("experience_risk")))
    best = (s.orderBy(F.desc("balanced_value_score"), F.asc("segment")).limit(top_n)
            .withColumn("list_gap", F.lit(None).cast("double")).withColumn("list", F.lit("best_balanced")))
    shown = Window.partitionBy("list").orderBy(F.desc(F.coalesce("list_gap", "balanced_value_score")), F.asc("segment"))
    return under.unionByName(risk).unionByName(best).withColumn("position", F.row_number().over(shown))


def portfolio_monetization_kpis(df: DataFrame) -> DataFrame:
    """A8 - weighted portfolio scores plus the top segment of each guardrail list (or 'None flagged').

    One aggregate over the market x device summary: portfolio means are
    re-assembled from the per-segment weighted sums, and the list heads are
    ``min_by`` over (negated rounded gap, name) - the same order the lists use.
    """
    s = guardrail_summary(df)
    mean = lambda n: safe_div(exact_sum(f"_sx_{n}"), F.sum("households"))
    under_key = F.when(F.col("gap") > GAP_THRESHOLD, F.struct(-rint_round(F.col("gap"), 1), F.col("segment")))
    risk_key = F.when(F.col("gap") < -GAP_THRESHOLD, F.struct(-rint_round(-F.col("gap"), 1), F.col("segment")))
    return s.agg(
        mean("revenue_per_household").alias("avg_revenue_per_household"),
        mean("monetization_per_streaming_hour").alias("avg_monetization_per_hour"),
        mean("monetization_depth_score").alias("avg_monetization_depth"),
        mean("experience_health_score").alias("avg_experience_health"),
        mean("balanced_value_score").alias("avg_balanced_value"),
        F.coalesce(F.min_by("segment", under_key), F.lit("None flagged")).alias("top_under_monetized"),
        F.coalesce(F.min_by("segment", risk_key), F.lit("None flagged")).alias("top_experience_risk"),
    )
