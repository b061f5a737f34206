"""A9-A12, A15-A17 dataset views and F1-F4 filters/scopes.

Filters always run on the already-scored baseline: ranks and terciles are
global and must be computed before any scope is applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.numeric import exact_mean, rint_round, weighted_mean
from cohortlens.operators.monetization import monetization_summary
from cohortlens.operators.segments import segment_summary
from cohortlens.schema import RETENTION_COLUMNS, RETENTION_MONTHS

QUADRANT_SPLIT = 50.0
GRID_STEP = 5.0


# ----------------------------------------------------------------- filters ----

def filter_cohorts(df: DataFrame, markets=None, regions=None, devices=None, cohorts=None,
                   segments=None) -> DataFrame:
    """F1 - five-way multi-select; an empty or missing list means all; AND across dimensions."""
    for col, values in (("market", markets), ("region", regions), ("device_type", devices),
                        ("cohort_month", cohorts), ("engagement_segment", segments)):
        if values:
            df = df.where(F.col(col).isin(list(values)))
    return df


ALL = None


def scope(df: DataFrame, market: str | None = ALL, device: str | None = ALL, segment: str | None = ALL) -> DataFrame:
    """F2/F3 - market x device (x segment) scope; ``None`` (the "All ..." choice) means no filter."""
    if market is not None:
        df = df.where(F.col("market") == market)
    if device is not None:
        df = df.where(F.col("device_type") == device)
    if segment is not None:
        df = df.where(F.col("engagement_segment") == segment)
    return df


def require_rows(df: DataFrame, message: str = "No households match this scope — widen the filters.") -> DataFrame:
    """F3 stop rule: raise when a scope is empty (``isEmpty`` reads at most one row)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


# ------------------------------------------------------------------- views ----

def coverage(df: DataFrame) -> DataFrame:
    """A9 - by market, region: distinct cohorts, households, UNWEIGHTED mean m6 and CLV (2 dp)."""
    return df.groupBy("market", "region").agg(
        F.count_distinct("cohort_month").alias("cohorts"),
        F.sum("households").alias("households"),
        rint_round(exact_mean("month_6_retention"), 2).alias("avg_m6_retention_unweighted"),
        rint_round(exact_mean("discounted_clv"), 2).alias("avg_clv_unweighted"),
    )


def cardinalities(df: DataFrame) -> DataFrame:
    """A10 - row count and distinct markets, cohort months, device types (one aggregate)."""
    return df.agg(
        F.count(F.lit(1)).alias("cohort_rows"),
        F.count_distinct("market").alias("markets"),
        F.count_distinct("cohort_month").alias("cohort_months"),
        F.count_distinct("device_type").alias("device_types"),
    )


def retention_curves(df: DataFrame, by: str = "engagement_segment") -> DataFrame:
    """A11 - household-weighted retention at months 1/3/6/12 per segment, long form."""
    wide = df.groupBy(by).agg(*[weighted_mean(c).alias(f"m{m}") for c, m in zip(RETENTION_COLUMNS, RETENTION_MONTHS)])
    args = ", ".join(f"'Month {m}', {m}, m{m}" for m in RETENTION_MONTHS)
    return wide.selectExpr(f"`{by}` AS segment", f"stack({len(RETENTION_MONTHS)}, {args}) AS (month_label, month, retention)")


def headline_gaps(df: DataFrame) -> DataFrame:
    """A12 - High vs Low CLV premium, m6 gap (pts), top market and its share of lifecycle value.

    Tidy ``(metric, value, label)`` rows from two small aggregates (segment
    level and market level), combined by union - no join. Missing High/Low
    segments give NULL values.
    """
    seg = segment_summary(df, "engagement_segment")
    clv = lambda s: F.max(F.when(F.col("engagement_segment") == s, F.col("avg_clv")))
    m6 = lambda s: F.max(F.when(F.col("engagement_segment") == s, F.col("avg_month_6_retention")))
    seg_row = seg.agg(
        F.try_divide(clv("High"), clv("Low")).alias("ratio"),
        ((m6("High") - m6("Low")) * F.lit(100.0)).alias("m6_gap_pts"),
    ).selectExpr("stack(2, 'high_vs_low_clv_premium', ratio - 1.0, CAST(NULL AS STRING), "
                 "'high_vs_low_m6_gap_pts', m6_gap_pts, CAST(NULL AS STRING)) AS (metric, value, label)")
    mkt = segment_summary(df, "market")
    order_key = F.struct(-F.col("avg_clv"), F.col("market"))
    mkt_row = mkt.agg(
        F.min_by("market", order_key).alias("top_market"),
        F.try_divide(F.min_by("total_lifecycle_value", order_key), F.sum("total_lifecycle_value")).alias("share"),
        F.min_by("total_lifecycle_value", order_key).alias("tlv"),
    ).selectExpr("stack(2, 'top_market_value_share', share, top_market, "
                 "'top_market_lifecycle_value', tlv, top_market) AS (metric, value, label)")
    return seg_row.unionByName(mkt_row)


def yield_by(df: DataFrame, by: str) -> DataFrame:
    """A15 - monetization summary by a dimension, ``position`` ascending by yield per hour (over the dimension's values only)."""
    shown = Window.orderBy(F.asc("monetization_per_streaming_hour"), F.asc(by))
    return monetization_summary(df, by).withColumn("position", F.row_number().over(shown))


def clv_by_cohort(df: DataFrame) -> DataFrame:
    """A16 - segment summary by cohort month, ``position`` in month order (over the months only)."""
    return segment_summary(df, "cohort_month").withColumn("position", F.row_number().over(Window.orderBy("cohort_month")))


def quadrant(depth="monetization_depth_score", health="experience_health_score") -> F.Column:
    x, y = F.col(depth), F.col(health)
    return (F.when((x < QUADRANT_SPLIT) & (y >= QUADRANT_SPLIT), "engaged_under_monetized")
            .when((x >= QUADRANT_SPLIT) & (y < QUADRANT_SPLIT), "monetized_experience_risk")
            .when(x >= QUADRANT_SPLIT, "healthy_monetized")
            .otherwise("low_depth_low_health"))


def score_points(df: DataFrame) -> DataFrame:
    """A17 - row-level score/value points with weight, labels and depth/health quadrant."""
    return df.select("cohort_month", "market", "device_type", "engagement_segment", "households",
                     "engagement_score", "discounted_clv", "monetization_depth_score", "experience_health_score",
                     quadrant().alias("quadrant"))


def score_grid(df: DataFrame, step: float = GRID_STEP) -> DataFrame:
    """A17 at scale - depth x health points binned to a ``step``-point grid with household weight."""
    return df.groupBy(
        (F.floor(F.col("monetization_depth_score") / step) * step).alias("depth_bin"),
        (F.floor(F.col("experience_health_score") / step) * step).alias("health_bin"),
        quadrant().alias("quadrant"),
    ).agg(F.count(F.lit(1)).alias("cohort_rows"), F.sum("households").alias("households"),
          weighted_mean("discounted_clv").alias("avg_clv"))


def point_grid(df: DataFrame, x: str, y: str, x_cells: float, y_cells: float) -> DataFrame:
    """A17 at scale - points (x, y) counted on a grid with so many cells per unit of each axis."""
    cell = lambda c, n: (F.floor(F.col(c) * F.lit(float(n))) / F.lit(float(n)))
    return df.groupBy(cell(x, x_cells).alias("x_bin"), cell(y, y_cells).alias("y_bin")).agg(
        F.count(F.lit(1)).alias("cohort_rows"), F.sum("households").alias("households"),
        weighted_mean("experience_health_score").alias("avg_health"))
