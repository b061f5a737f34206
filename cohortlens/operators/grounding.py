"""N1-N7 grounding facts: the model outputs a narrative may quote, as a long table.

``facts(context_id, path, value_double, value_string)``: one row per number or
label of a context (``portfolio_kpis.avg_clv``, ``by_market[0].market``, ...).
Summary tables are cut to their first rows with ``orderBy().limit()``
(TakeOrdered) before any row numbering, so no global sort of a large table
happens; numbers are rounded to 3 dp like the prompt context they stand for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.numeric import exact_sum, rint_round, weighted_mean
from cohortlens.operators import monetization as mon
from cohortlens.operators import value
from cohortlens.operators.segments import SUMMARY_METRICS, segment_summary

FACT_SCHEMA = T.StructType([
    T.StructField("context_id", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("value_double", T.DoubleType()), T.StructField("value_string", T.StringType()),
])
RECORD_LIMIT = 12
ROUND_DIGITS = 3


def _entry_sql(name: str, dtype: T.DataType, digits: int | None) -> tuple[str, str]:
    c = f"`{name}`"
    if isinstance(dtype, T.StringType):
        return "CAST(NULL AS DOUBLE)", c
    if isinstance(dtype, T.BooleanType):
        return "CAST(NULL AS DOUBLE)", f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
    x = f"CAST({c} AS DOUBLE)"
    if digits is not None and not isinstance(dtype, (T.IntegerType, T.LongType)):
        scale = f"{float(10 ** digits)!r}D"
        x = f"(rint({x} * {scale}) / {scale} + 0.0D)"
    return x, "CAST(NULL AS STRING)"


def record_facts(df: DataFrame, context_id: str, prefix: str, digits: int | None = ROUND_DIGITS) -> DataFrame:
    """A one-row table as ``prefix.column`` facts (one ``inline`` expression)."""
    structs = []
    for f in df.schema.fields:
        vd, vs = _entry_sql(f.name, f.dataType, digits)
        structs.append(f"named_struct('path', '{prefix}.{f.name}', 'value_double', {vd}, 'value_string', {vs})")
    return df.selectExpr(f"'{context_id}' AS context_id", f"inline(array({', '.join(structs)}))")


def records_facts(df: DataFrame, context_id: str, prefix: str, order: list[Column], limit: int = RECORD_LIMIT,
                  digits: int | None = ROUND_DIGITS) -> DataFrame:
    """The first ``limit`` rows of a summary table as ``prefix[i].column`` facts."""
    top = df.orderBy(*order).limit(limit)
    top = top.withColumn("__i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1)
    structs = []
    for f in df.schema.fields:
        vd, vs = _entry_sql(f.name, f.dataType, digits)
        path = f"concat('{prefix}[', CAST(__i AS STRING), '].{f.name}')"
        structs.append(f"named_struct('path', {path}, 'value_double', {vd}, 'value_string', {vs})")
    return top.selectExpr(f"'{context_id}' AS context_id", f"inline(array({', '.join(structs)}))")


def _by(df: DataFrame, dim: str) -> DataFrame:
    return segment_summary(df, dim)


BASE_DIMS = [("engagement_segment", "by_engagement_segment"), ("market", "by_market"),
             ("device_type", "by_device_type")]


def base_facts(df: DataFrame, context_id: str) -> DataFrame:
    """N1 - portfolio KPIs + segment / market / device summaries (first 12 rows each).

    One aggregate with GROUPING SETS ((), (segment), (market), (device)) gives
    the KPI row and all three summaries in a single shuffle; the first rows of
    each summary are picked by a window partitioned by dimension over that
    small aggregated result.
    """
    w = F.col("households")
    dims = [d for d, _ in BASE_DIMS]
    g = df.groupingSets([[]] + [[d] for d in dims], *dims).agg(
        F.grouping_id().alias("__gid"),
        F.sum(w).alias("households"),
        *[weighted_mean(src).alias(name) for name, src in SUMMARY_METRICS],
        exact_sum("discounted_clv", w).alias("total_lifecycle_value"),
        exact_sum("total_lifecycle_value").alias("__tlv_rows"),
        weighted_mean("expected_retained_months").alias("__months"),
        weighted_mean("gross_profit_per_household").alias("__gp"),
        exact_sum("ad_revenue_per_household", w).alias("__ad"),
        exact_sum("total_monthly_revenue_per_household", w).alias("__rev"),
    )  # consumed four times below; within one job Spark reuses its exchange
    full = (1 << len(dims)) - 1
    kpis = g.where((F.col("__gid") == full) & (F.col("households") > 0)).select(
        F.col("households").alias("total_households"), F.col("avg_clv"),
        F.col("__tlv_rows").alias("total_lifecycle_value"), F.col("avg_month_6_retention"),
        F.col("avg_monthly_revenue").alias("avg_revenue_per_household"),
        F.col("__gp").alias("avg_gross_profit_per_household"),
        F.col("__months").alias("avg_expected_retained_months"),
        (F.col("__ad") / F.greatest(F.col("__rev"), F.lit(1e-9))).alias("ad_revenue_share"))
    parts = [record_facts(kpis, context_id, "portfolio_kpis")]
    cols = ["households"] + [n for n, _ in SUMMARY_METRICS] + ["total_lifecycle_value"]
    for i, (dim, name) in enumerate(BASE_DIMS):
        gid = full & ~(1 << (len(dims) - 1 - i))
        t = g.where(F.col("__gid") == gid).select(dim, *cols)
        parts.append(records_facts(t, context_id, name, [F.desc("avg_clv"), F.asc(dim)]))
    return _union(parts)


def cohort_facts(df: DataFrame, context_id: str, filters: dict) -> DataFrame:
    """N2 - N1 + the active filters + summary by cohort month."""
    spark = df.sparkSession
    rows = [(context_id, f"active_filters.{k}[{i}]", None, str(v)) for k, vals in filters.items()
            for i, v in enumerate(vals or [])]
    parts = [base_facts(df, context_id), spark.createDataFrame(rows, FACT_SCHEMA),
             records_facts(_by(df, "cohort_month"), context_id, "by_cohort_month",
                           [F.desc("avg_clv"), F.asc("cohort_month")])]
    return _union(parts)


def driver_facts(df: DataFrame, context_id: str) -> DataFrame:
    """N3 - N1 + revenue mix."""
    k = value.portfolio_kpis(df).select(
        rint_round("ad_revenue_share", 3).alias("ad_revenue_share"),
        rint_round(F.lit(1.0) - F.col("ad_revenue_share"), 3).alias("subscription_revenue_share"))
    return _union([base_facts(df, context_id), record_facts(k, context_id, "revenue_mix", None)])


KPI_KEYS = value.KPI_NAMES


def scenario_facts(comparison: DataFrame, scenario_id: str, levers: dict, scope_label: str,
                   context_id: str) -> DataFrame:
    """N4 - scope, levers, both KPI sets (3 dp), value deltas and guardrails of one compared scenario."""
    c = comparison.where(F.col("scenario_id") == scenario_id)
    spark = comparison.sparkSession
    head = spark.createDataFrame(
        [(context_id, "scenario_scope", None, scope_label)]
        + [(context_id, f"scenario_levers.{k}", float(v), None) for k, v in levers.items()], FACT_SCHEMA)
    src = lambda side, k: F.col("households") if k == "total_households" else F.col(f"{side}_{k}")
    base = c.select(*[src("baseline", k).alias(k) for k in KPI_KEYS])
    scen = c.select(*[src("scenario", k).alias(k) for k in KPI_KEYS])
    money = c.select(
        rint_round("incremental_value", 0).alias("incremental_value"),
        rint_round("clv_lift_pct", 4).alias("clv_lift_pct"), "roi", "payback_months", "initiative_cost")
    guard = c.select(
        rint_round("baseline_mph", 4).alias("monetization_per_hour_baseline"),
        rint_round("scenario_mph", 4).alias("monetization_per_hour_scenario"),
        rint_round("month_6_retention_delta_pts", 2).alias("month_6_retention_delta_pts"),
        rint_round("streaming_hours_change_pct", 4).alias("streaming_hours_change_pct"))
    money_facts = record_facts(money, context_id, "_", None).withColumn(
        "path", F.regexp_replace("path", r"^_\.", ""))
    return _union([head, record_facts(base, context_id, "baseline_kpis"),
                   record_facts(scen, context_id, "scenario_kpis"), money_facts,
                   record_facts(guard, context_id, "monetization_and_experience_guardrails", None)])


def guardrail_facts(df: DataFrame, context_id: str) -> DataFrame:
    """N5 - monetization KPIs + the three guardrail lists (5 rows each)."""
    k = mon.portfolio_monetization_kpis(df)
    g = mon.guardrail_segments(df)
    cols = ["segment", "households"] + [n for n, _ in mon.MONETIZATION_SUMMARY]
    parts = [record_facts(k, context_id, "portfolio_monetization_kpis")]
    for lst, name, gap in (("under_monetized", "engaged_under_monetized_segments", "opportunity_gap"),
                           ("experience_risk", "monetized_experience_risk_segments", "risk_gap"),
                           ("best_balanced", "best_balanced_segments", None)):
        t = g.where(F.col("list") == lst).select(*cols, *( [F.col("list_gap").alias(gap)] if gap else []))
        order = [F.desc(gap), F.asc("segment")] if gap else [F.desc("balanced_value_score"), F.asc("segment")]
        parts.append(records_facts(t, context_id, name, order, 5))
    return _union(parts)


RANKING_COLUMNS = ["rank", "initiative", "classification", "balanced_score", "monetization_lift", "experience_impact",
                   "retention_risk", "incremental_value", "clv_lift_pct", "roi", "payback_months", "confidence",
                   "complexity", "score"]
MEMO_COLUMNS = ["rank", "initiative", "classification", "incremental_value", "roi", "payback_months", "score",
                "balanced_score", "monetization_lift", "experience_impact", "retention_risk"]


def ranking_facts(ranked: DataFrame, context_id: str) -> DataFrame:
    """N6 - the ranked initiative table (14 columns, 12 rows)."""
    return records_facts(ranked.select(*RANKING_COLUMNS), context_id, "ranked_initiatives", [F.asc("rank")])


def insight_facts(insights_tidy: DataFrame, context_id: str) -> DataFrame:
    return insights_tidy.select(
        F.lit(context_id).alias("context_id"),
        F.concat(F.lit("gap_insights_non_obvious."), F.col("insight"), F.lit("."), F.col("metric")).alias("path"),
        "value_double", "value_string")


def active_scenario_facts(comparison: DataFrame, scenario_id: str, levers: dict, scope_label: str,
                          context_id: str) -> DataFrame:
    """The scenario under discussion: levers, scope, value, lift, ROI and payback."""
    name = "active_scenario"
    head = comparison.sparkSession.createDataFrame(
        [(context_id, f"{name}.levers.{k}", float(v), None) for k, v in levers.items()]
        + [(context_id, f"{name}.scope", None, scope_label)], FACT_SCHEMA)
    money = comparison.where(F.col("scenario_id") == scenario_id).select(
        rint_round("incremental_value", 0).alias("incremental_value"),
        rint_round("clv_lift_pct", 4).alias("clv_lift_pct"), "roi", "payback_months")
    return head.unionByName(record_facts(money, context_id, name, None))


def memo_facts(df: DataFrame, ranked: DataFrame, insights_tidy: DataFrame, context_id: str,
               active: DataFrame | None = None) -> DataFrame:
    """N7 - N1 + gap insights + top-8 initiatives + the facts of the active scenario, if there is one."""
    parts = [base_facts(df, context_id), insight_facts(insights_tidy, context_id),
             records_facts(ranked.select(*MEMO_COLUMNS), context_id, "top_initiatives", [F.asc("rank")], 8)]
    return _union(parts + ([active] if active is not None else []))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
