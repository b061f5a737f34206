"""P1-P18, A4, A5, A13, A14 - revenue, profit, survival and lifetime value.

``run_clv_model`` is a single narrow projection: the 24 survival terms are
unrolled expressions that Catalyst folds into one whole-stage-codegen span.
No ranks are needed here, so scenario fan-out never pays for them.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.cache import per_context
from cohortlens.functions.numeric import exact_sum, safe_div, weighted_mean
from cohortlens.functions.survival import discount_factor_columns, discount_factors, survival_terms
from cohortlens.schema import (
    AD_MONETIZATION_SHARE,
    CLV_HORIZON_MONTHS,
    DEFAULT_DISCOUNT_RATE,
    SUBSCRIPTION_REVENUE_SHARE,
)

CLV_COLUMNS = [
    "ad_revenue_per_household",
    "subscription_revenue_per_household",
    "total_monthly_revenue_per_household",
    "gross_profit_per_household",
    "expected_retained_months",
    "baseline_clv",
    "discounted_clv",
    "total_lifecycle_value",
]


@per_context
def _survival() -> list[Column]:
    return survival_terms(F.col("month_1_retention"), F.col("month_3_retention"),
                          F.col("month_6_retention"), F.col("month_12_retention"))


def revenue_columns() -> dict[str, Column]:
    ad = (F.col("monthly_streaming_hours") * F.col("ad_supported_share") * F.col("ad_impressions_per_hour")
          * F.col("fill_rate") * F.col("cpm") / F.lit(1000.0) * F.lit(AD_MONETIZATION_SHARE))
    sub = F.col("subscription_conversion_rate") * F.col("subscription_arpu") * F.lit(SUBSCRIPTION_REVENUE_SHARE)
    return {"ad_revenue_per_household": ad, "subscription_revenue_per_household": sub}


def _factors(annual_discount_rate: float | Column) -> list[Column]:
    """Discount factors of the 24 months; a column is a rate per row."""
    if isinstance(annual_discount_rate, Column):
        return discount_factor_columns(annual_discount_rate)
    return [F.lit(d) for d in discount_factors(float(annual_discount_rate))]


def _clv_stages(annual_discount_rate: float | Column) -> tuple[dict, dict]:
    return _stages(annual_discount_rate) if isinstance(annual_discount_rate, Column) else _stages_of_rate(float(annual_discount_rate))


@per_context
def _stages_of_rate(annual_discount_rate: float) -> tuple[dict, dict]:
    return _stages(annual_discount_rate)


def _stages(annual_discount_rate: float | Column) -> tuple[dict, dict]:
    """The model as two projections: revenue, profit and survival sums; then the CLV columns."""
    s = _survival()
    disc = _factors(annual_discount_rate)
    rev = revenue_columns()
    total = rev["ad_revenue_per_household"] + rev["subscription_revenue_per_household"]
    first = dict(rev)
    first["total_monthly_revenue_per_household"] = total
    first["gross_profit_per_household"] = total * F.col("gross_margin") - F.col("support_cost_per_household")
    first["expected_retained_months"] = reduce(add, s)
    first["_disc_surv"] = reduce(add, [st * d for st, d in zip(s, disc)])
    second = {
        "baseline_clv": F.col("gross_profit_per_household") * F.col("expected_retained_months"),
        "discounted_clv": F.col("_disc_surv") * F.col("gross_profit_per_household"),
    }
    return first, second


def run_clv_model(df: DataFrame, annual_discount_rate: float | Column = DEFAULT_DISCOUNT_RATE) -> DataFrame:
    """Append the eight CLV columns (P1-P9) in two narrow projections; the rate may be a column."""
    first, second = _clv_stages(annual_discount_rate)
    out = df.withColumns(first).withColumns(second)
    out = out.withColumn("total_lifecycle_value", F.col("discounted_clv") * F.col("households"))
    return out.drop("_disc_surv")


def survival_long(df: DataFrame, keys: list[str]) -> DataFrame:
    """P5 in long form: ``keys + (month, survival)`` for t = 1..24."""
    s = _survival()
    arr = F.array(*[F.struct(F.lit(t + 1).alias("month"), st.alias("survival")) for t, st in enumerate(s)])
    return df.select(*keys, F.inline(arr))


# ---------------------------------------------------------------- rollups ----

@per_context
def kpi_aggs() -> list[Column]:
    """A4 portfolio KPIs as aggregate expressions (usable with or without groupBy)."""
    w = F.col("households")
    return [
        F.sum(w).alias("total_households"),
        weighted_mean("discounted_clv").alias("avg_clv"),
        exact_sum("total_lifecycle_value").alias("total_lifecycle_value"),
        weighted_mean("month_6_retention").alias("avg_month_6_retention"),
        weighted_mean("total_monthly_revenue_per_household").alias("avg_revenue_per_household"),
        weighted_mean("gross_profit_per_household").alias("avg_gross_profit_per_household"),
        weighted_mean("expected_retained_months").alias("avg_expected_retained_months"),
        (exact_sum("ad_revenue_per_household", w)
         / F.greatest(exact_sum("total_monthly_revenue_per_household", w), F.lit(1e-9))).alias("ad_revenue_share"),
    ]


KPI_NAMES = ["total_households", "avg_clv", "total_lifecycle_value", "avg_month_6_retention",
             "avg_revenue_per_household", "avg_gross_profit_per_household",
             "avg_expected_retained_months", "ad_revenue_share"]


def portfolio_kpis(df: DataFrame, by: list[str] | None = None, acquisition_cost: float | None = None) -> DataFrame:
    """A4 (+P10-P12 when a CAC is given). Empty result when the weight total is 0."""
    g = df.groupBy(*by) if by else df
    out = g.agg(*kpi_aggs()).where(F.col("total_households") > 0)
    if acquisition_cost is not None:
        out = with_unit_economics(out, acquisition_cost)
    return out


def with_unit_economics(kpis: DataFrame, acquisition_cost: float) -> DataFrame:
    """P10 net CLV, P11 CLV:CAC (NULL when CAC <= 0), P12 underwater flag."""
    cac = F.lit(float(acquisition_cost))
    return kpis.withColumns({
        "acquisition_cost": cac,
        "net_clv": F.col("avg_clv") - cac,
        "clv_to_cac": F.when(cac > 0, F.col("avg_clv") / cac),
        "underwater": (F.col("avg_clv") - cac) < 0,
    })


@per_context
def _payback_of_rate(acquisition_cost: float, annual_discount_rate: float) -> tuple[list[Column], Column, Column]:
    return _payback_exprs(acquisition_cost, annual_discount_rate)


def _payback_exprs(acquisition_cost: float, annual_discount_rate: float | Column) -> tuple[list[Column], Column, Column]:
    s = _survival()
    disc = _factors(annual_discount_rate)
    w = F.col("households")
    gp = F.col("gross_profit_per_household")
    aggs = [F.sum(w).alias("_w")] + [exact_sum(st * d * gp, w).alias(f"_st{t + 1}")
                                     for t, (st, d) in enumerate(zip(s, disc))]
    stream = [safe_div(F.col(f"_st{t}"), F.col("_w")) for t in range(1, CLV_HORIZON_MONTHS + 1)]
    cum = []
    running = None
    for st in stream:
        running = st if running is None else running + st
        cum.append(running)
    cac = F.lit(float(acquisition_cost))
    first = F.lit(None).cast("int")
    for t in range(CLV_HORIZON_MONTHS, 0, -1):
        first = F.when(cum[t - 1] >= cac, F.lit(t)).otherwise(first)
    result = (F.when(cac <= 0, F.lit(0))
              .when((F.col("_w") == 0) | cum[-1].isNull() | (cum[-1] < cac), F.lit(None).cast("int"))
              .otherwise(first))
    return aggs, result, cum[-1]


def payback_month(df: DataFrame, acquisition_cost: float,
                  annual_discount_rate: float | Column = DEFAULT_DISCOUNT_RATE,
                  by: list[str] | None = None) -> DataFrame:
    """A5 - first month whose cumulative weighted discounted gross profit covers CAC.

    One aggregate computes the 24 weighted stream sums; running sums and the
    first crossing are evaluated on the (tiny) aggregated row. 0 when CAC <= 0,
    NULL when the last cumulative value stays below CAC (or the weight is 0).
    """
    per_row = isinstance(annual_discount_rate, Column)
    aggs, result, last = (_payback_exprs if per_row else _payback_of_rate)(float(acquisition_cost), annual_discount_rate if per_row else float(annual_discount_rate))
    g = df.groupBy(*by) if by else df
    a = g.agg(*aggs)
    return a.select(*(by or []), F.col("_w").alias("households"), result.alias("payback_month"),
                    last.alias("cumulative_discounted_gp_24"))


def walkthrough(df: DataFrame, acquisition_cost: float, annual_discount_rate: float = DEFAULT_DISCOUNT_RATE) -> DataFrame:
    """A13 - the average household through the model, as ordered steps ``(step, name, value)``."""
    a = df.agg(
        weighted_mean("ad_revenue_per_household").alias("ad_revenue"),
        weighted_mean("subscription_revenue_per_household").alias("subscription_revenue"),
        weighted_mean("total_monthly_revenue_per_household").alias("monthly_revenue"),
        weighted_mean("gross_margin").alias("gross_margin"),
        weighted_mean("support_cost_per_household").alias("support_cost"),
        weighted_mean("gross_profit_per_household").alias("gross_profit"),
        weighted_mean("expected_retained_months").alias("retained_months"),
        weighted_mean("baseline_clv").alias("lifetime_gross_profit"),
        weighted_mean("discounted_clv").alias("gross_clv"),
        F.sum("households").alias("_w"),
    ).where(F.col("_w") > 0)
    a = a.withColumns({"discount_rate": F.lit(float(annual_discount_rate)),
                       "acquisition_cost": F.lit(float(acquisition_cost)),
                       "net_clv": F.col("gross_clv") - F.lit(float(acquisition_cost))})
    steps = ["ad_revenue", "subscription_revenue", "monthly_revenue", "gross_margin", "support_cost",
             "gross_profit", "retained_months", "lifetime_gross_profit", "discount_rate", "gross_clv",
             "acquisition_cost", "net_clv"]
    args = ", ".join(f"{i + 1}, '{n}', `{n}`" for i, n in enumerate(steps))
    return a.selectExpr(f"stack({len(steps)}, {args}) AS (step, name, value)")


def revenue_mix(df: DataFrame) -> DataFrame:
    """A14 - ad vs subscription share of revenue (two rows)."""
    k = df.agg(*kpi_aggs()).where(F.col("total_households") > 0)
    return k.selectExpr("stack(2, 'ad_revenue', ad_revenue_share, "
                        "'subscription_revenue', 1.0 - ad_revenue_share) AS (revenue_type, share)")


AUDIT_COLUMNS = ["cohort_month", "market", "device_type", "engagement_segment", "households",
                 "ad_revenue_per_household", "subscription_revenue_per_household",
                 "total_monthly_revenue_per_household", "gross_profit_per_household",
                 "expected_retained_months", "baseline_clv", "discounted_clv"]
