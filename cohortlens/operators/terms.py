"""P8, P10-P12, A4, A5 for many discount rates and acquisition costs at once.

The discounted lifetime value of a group is linear in its 24 undiscounted profit terms: term t is the household-weighted
sum of profit times survival in month t. One aggregate gives the terms; every rate and cost is then evaluated
on the aggregated rows, so a thousand pairs read the baseline as often as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numeric import exact_sum, safe_div
from cohortlens.functions.survival import discount_factor_columns
from cohortlens.operators.value import _survival
from cohortlens.schema import CLV_HORIZON_MONTHS

MONTHS = range(1, CLV_HORIZON_MONTHS + 1)


def profit_terms(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by + (households, term_1..term_24)``: weighted sums of undiscounted monthly profit; groups without weight go."""
    w, gp = F.col("households"), F.col("gross_profit_per_household")
    aggs = [F.sum(w).alias("households"), *[exact_sum(s * gp, w).alias(f"term_{t}") for t, s in zip(MONTHS, _survival())]]
    return (df.groupBy(*by) if by else df).agg(*aggs).where(F.col("households") > 0)


def evaluate_terms(terms: DataFrame, rate: Column, cost: Column, keep: list[str]) -> DataFrame:
    """``keep + (avg_clv, net_clv, clv_to_cac, underwater, payback_month)`` at the rate and cost that each row of ``terms`` carries.

    ``clv_to_cac`` is NULL for a cost of 0 or less; the payback month is then 0, and NULL where 24 months do not cover the cost.
    """
    running, cum = None, []
    for t, factor in zip(MONTHS, discount_factor_columns(rate)):
        stream = safe_div(F.col(f"term_{t}") * factor, F.col("households"))
        running = stream if running is None else running + stream
        cum.append(f"__c{t}")
        terms = terms.withColumn(f"__c{t}", running)
        running = F.col(f"__c{t}")
    clv = F.col(cum[-1])
    first = F.coalesce(*[F.when(F.col(c) >= cost, F.lit(t)) for t, c in zip(MONTHS, cum)])
    return terms.select(*keep, clv.alias("avg_clv"), (clv - cost).alias("net_clv"), F.when(cost > 0, safe_div(clv, cost)).alias("clv_to_cac"),
                        ((clv - cost) < 0).alias("underwater"), F.when(cost <= 0, F.lit(0)).when(clv >= cost, first).alias("payback_month"))


def terms_grid(df: DataFrame, rates: list[float], costs: list[float], by: list[str] | None = None) -> DataFrame:
    """Unit economics of every rate with every cost, per group: one scan of ``df``, whatever the number of pairs."""
    names = {"discount_rate": rates, "acquisition_cost": costs}
    terms = profit_terms(df, by)
    for name, values in names.items():
        terms = terms.withColumn(name, F.explode(F.lit([float(v) for v in values])))
    return evaluate_terms(terms, F.col("discount_rate"), F.col("acquisition_cost"), [*(by or []), *names, "households"])
