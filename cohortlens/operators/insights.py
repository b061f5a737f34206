"""G1-G4 gap insights: under-monetized pocket, vintage trend, marginal retention value.

Each insight is one or two aggregates over the scored baseline; the
per-segment / per-market intermediate tables are bounded by the dimension
cardinalities (markets x devices), not by the data volume, so the final
selections over them use global windows or ``min_by``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.numeric import exact_sum, rint_round, safe_div, weighted_mean
from cohortlens.operators.monetization import segment_key
from cohortlens.operators.scenario import Scenario, fan_out
from cohortlens.schema import DEFAULT_DISCOUNT_RATE

MIN_VINTAGE_MONTHS = 4
VINTAGE_WINDOW = 3
MARGINAL_RETENTION_LIFT = 0.05
MARGINAL_RETENTION_POINTS = 5.0
CLOSE_GAP_SHARE = 0.5
MIX_DRIVER = "cohort mix (market/device composition)"


def under_monetized(df: DataFrame) -> DataFrame:
    """G1 - the engaged pocket monetizing furthest below the portfolio yield (0 or 1 row)."""
    seg = df.withColumn("segment", segment_key())
    w = F.col("households")
    s = seg.groupBy("segment").agg(
        F.sum(w).alias("households"),
        exact_sum("monetization_per_streaming_hour", w).alias("_s_mph"),
        weighted_mean("monetization_per_streaming_hour").alias("mph"),
        weighted_mean("monthly_streaming_hours").alias("hours"),
        weighted_mean("experience_health_score").alias("health"),
    )
    everything = Window.partitionBy(F.lit(1))  # over the market x device table only
    s = s.withColumns({
        "port_mph": safe_div(exact_sum("_s_mph", over=everything), F.sum("households").over(everything)),
        "median_health": F.median("health").over(everything),
    })
    cand = s.where((F.col("health") >= F.col("median_health")) & (F.col("mph") < F.col("port_mph")))
    cand = cand.withColumn("annual_gap_value",
                           (F.col("port_mph") - F.col("mph")) * F.col("hours") * F.col("households") * F.lit(12.0))
    best = cand.orderBy(F.desc("annual_gap_value"), F.asc("segment")).limit(1)
    return best.select(
        "segment", "households",
        rint_round("mph", 3).alias("segment_yield_per_hour"),
        rint_round("port_mph", 3).alias("portfolio_yield_per_hour"),
        rint_round(F.col("mph") / F.col("port_mph") - F.lit(1.0), 3).alias("yield_gap_pct"),
        rint_round("health", 1).alias("experience_health"),
        rint_round(F.col("annual_gap_value") * F.lit(CLOSE_GAP_SHARE), 0).alias("annual_value_of_closing_half_gap"),
    )


def vintage_trend(df: DataFrame) -> DataFrame:
    """G2 - newest 3 vs oldest 3 cohort months (overlapping when fewer than 6), 0 or 1 row.

    Only the first and last few distinct months reach the driver, however many
    there are; one conditional aggregate does the rest.
    """
    months = df.select("cohort_month").where(F.col("cohort_month").isNotNull()).distinct()
    oldest = [r[0] for r in months.orderBy("cohort_month").limit(MIN_VINTAGE_MONTHS).collect()]
    newest = [r[0] for r in months.orderBy(F.desc("cohort_month")).limit(VINTAGE_WINDOW).collect()]
    if len(oldest) < MIN_VINTAGE_MONTHS:
        return df.sparkSession.createDataFrame(
            [], "oldest_cohorts string, newest_cohorts string, clv_delta_pct double, "
                "month_6_retention_delta_pts double, revenue_per_hh_delta_pct double, primary_driver string")
    early, late = oldest[:VINTAGE_WINDOW], sorted(newest)
    w = F.col("households")
    is_e, is_l = F.col("cohort_month").isin(early), F.col("cohort_month").isin(late)

    def wm(cond, c):
        return weighted_mean(F.when(cond, F.col(c)), F.when(cond, w))

    a = df.agg(wm(is_e, "discounted_clv").alias("e_clv"), wm(is_l, "discounted_clv").alias("l_clv"),
               wm(is_e, "month_6_retention").alias("e_m6"), wm(is_l, "month_6_retention").alias("l_m6"),
               wm(is_e, "total_monthly_revenue_per_household").alias("e_rev"),
               wm(is_l, "total_monthly_revenue_per_household").alias("l_rev"))
    a = a.where(F.col("e_clv") != 0)
    clv_d = F.col("l_clv") / F.col("e_clv") - F.lit(1.0)
    rev_d = F.when(F.col("e_rev") != 0, F.col("l_rev") / F.col("e_rev") - F.lit(1.0)).otherwise(F.lit(0.0))
    m6_d = F.when(F.col("e_m6") != 0, F.col("l_m6") / F.col("e_m6") - F.lit(1.0)).otherwise(F.lit(0.0))
    a = a.withColumns({"clv_d": clv_d, "rev_d": rev_d, "m6_d": m6_d})
    same = lambda x: (F.col(x) >= 0) == (F.col("clv_d") >= 0)
    ret_ok, mon_ok = same("m6_d"), same("rev_d")
    driver = (F.when(ret_ok & mon_ok, F.when(F.abs("m6_d") >= F.abs("rev_d"), "retention").otherwise("monetization"))
              .when(ret_ok, "retention").when(mon_ok, "monetization").otherwise(MIX_DRIVER))
    return a.select(
        F.lit(f"{early[0]} – {early[-1]}").alias("oldest_cohorts"),
        F.lit(f"{late[0]} – {late[-1]}").alias("newest_cohorts"),
        rint_round("clv_d", 3).alias("clv_delta_pct"),
        rint_round((F.col("l_m6") - F.col("e_m6")) * F.lit(100.0), 1).alias("month_6_retention_delta_pts"),
        rint_round("rev_d", 3).alias("revenue_per_hh_delta_pct"),
        driver.alias("primary_driver"),
    )


def marginal_retention_by_market(df: DataFrame, annual_discount_rate: float = DEFAULT_DISCOUNT_RATE) -> DataFrame:
    """G3 per market: discounted CLV gained per household per +1 % retention (via a +5 % lift)."""
    scen = fan_out(df, [Scenario("retention_plus_5", {"retention_lift": MARGINAL_RETENTION_LIFT})],
                   annual_discount_rate)
    m = scen.groupBy("market").agg(
        F.sum("households").alias("households"),
        weighted_mean("b_clv").alias("base_clv"), weighted_mean("discounted_clv").alias("scen_clv"))
    m = m.withColumn("value_per_hh_per_pct", (F.col("scen_clv") - F.col("base_clv")) / F.lit(MARGINAL_RETENTION_POINTS))
    return m.withColumn("total_per_pct", F.col("value_per_hh_per_pct") * F.col("households"))


def marginal_retention(df: DataFrame, annual_discount_rate: float = DEFAULT_DISCOUNT_RATE) -> DataFrame:
    """G3 - best / worst market per household, spread, largest total (0 rows with fewer than 2 markets)."""
    m = marginal_retention_by_market(df, annual_discount_rate)
    best_key = F.struct(-F.col("value_per_hh_per_pct"), F.col("market"))
    worst_key = F.struct(F.col("value_per_hh_per_pct"), F.col("market"))
    total_key = F.struct(-F.col("total_per_pct"), F.col("market"))
    a = m.agg(
        F.count(F.lit(1)).alias("n_markets"),
        F.min_by("market", best_key).alias("best_market"),
        F.min_by("value_per_hh_per_pct", best_key).alias("best_v"),
        F.min_by("market", worst_key).alias("worst_market"),
        F.min_by("value_per_hh_per_pct", worst_key).alias("worst_v"),
        F.min_by("market", total_key).alias("largest_total_market"),
        F.min_by("total_per_pct", total_key).alias("largest_total"),
    ).where(F.col("n_markets") >= 2)
    return a.select(
        "best_market", rint_round("best_v", 2).alias("best_value_per_hh_per_pct_lift"),
        "worst_market", rint_round("worst_v", 2).alias("worst_value_per_hh_per_pct_lift"),
        F.when(F.col("worst_v") != 0, rint_round(F.col("best_v") / F.col("worst_v"), 1)).alias("spread_x"),
        "largest_total_market", rint_round("largest_total", 0).alias("largest_total_per_pct_lift"),
    )


def _tidy(df: DataFrame, insight: str) -> DataFrame:
    fields = [f for f in df.schema.fields]
    entries = []
    for f in fields:
        if f.dataType.simpleString() in ("string",):
            entries.append(f"'{f.name}', CAST(NULL AS DOUBLE), `{f.name}`")
        else:
            entries.append(f"'{f.name}', CAST(`{f.name}` AS DOUBLE), CAST(NULL AS STRING)")
    return df.selectExpr(f"'{insight}' AS insight",
                         f"stack({len(entries)}, {', '.join(entries)}) AS (metric, value_double, value_string)")


def gap_insights(df: DataFrame, annual_discount_rate: float = DEFAULT_DISCOUNT_RATE) -> DataFrame:
    """G4 - all insights that exist, as tidy ``(insight, metric, value_double, value_string)`` rows."""
    return (_tidy(under_monetized(df), "under_monetized_opportunity")
            .unionByName(_tidy(vintage_trend(df), "vintage_trend"))
            .unionByName(_tidy(marginal_retention(df, annual_discount_rate), "marginal_retention_value")))
