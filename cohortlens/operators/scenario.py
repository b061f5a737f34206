"""C1-C7 what-if scenarios, evaluated for a whole batch of scenarios in one job.

Each cohort row fans out to one row per scenario (``explode`` of the scenario
parameter list - a bounded, driver-held list of lever sets), the levers are
applied as plain column expressions, the CLV model re-runs in the same
projection, and a single ``groupBy(scenario_id)`` (partial aggregation
map-side, so the shuffle carries one row per scenario per task) yields the
baseline and scenario KPIs, guardrail read-out and verdict per scenario.
A scenario may carry a scope (market / device / segment); rows outside it are
dropped right after the fan-out. An empty scope yields no row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.cache import per_context
from cohortlens.functions.numeric import clip, exact_sum, weighted_mean
from cohortlens.operators.value import run_clv_model
from cohortlens.schema import (
    APP_INSTALL_TO_RETENTION,
    CLV_HORIZON_MONTHS,
    DEFAULT_DISCOUNT_RATE,
    FIRST_WEEK_TO_RETENTION,
    RETENTION_COLUMNS,
    RISK_TO_HOURS,
    SCENARIO_LEVERS,
    SCENARIO_MARGIN_CAP,
    SCENARIO_RETENTION_CAP,
    TRC_TO_HOURS,
    TRC_TO_RETENTION,
)

MAX_SCENARIOS_PER_PASS = 2_000
BLOCKS_PER_PASS = 32  # of a scenario table: 32 x 2,000 scenarios of about 150 bytes are broadcast, some 10 MB
RETENTION_GUARDRAIL_PTS = -0.5
MPH_UP_FACTOR = 1.001

# ---- fixed values: lever labels, in lever order -----------------------------
LEVER_LABELS = {
    "first_week_lift": "first-week engagement",
    "app_install_lift": "onboarding app installs",
    "trc_usage_lift": "free-channel usage",
    "sub_conversion_lift": "subscription conversion",
    "retention_lift": "retention (direct)",
    "cpm_lift": "CPM",
    "gross_margin_change": "gross margin (pts)",
    "experience_risk_penalty": "experience risk penalty",
}


@dataclass
class Scenario:
    scenario_id: str
    levers: dict = field(default_factory=dict)
    cost: float | None = None
    market: str | None = None
    device_type: str | None = None
    engagement_segment: str | None = None

    def lever(self, name: str) -> float:
        v = self.levers.get(name, 0.0)
        return 0.0 if v is None else float(v)


# ---- fixed values: scenario presets (levers, cost) --------------------------
PRESETS = [
    Scenario("onboarding_push", {"first_week_lift": 0.15, "app_install_lift": 0.10}, 750_000.0),
    Scenario("engagement_push", {"trc_usage_lift": 0.20}, 900_000.0),
    Scenario("monetization_push", {"cpm_lift": 0.10, "sub_conversion_lift": 0.15}, 600_000.0),
    Scenario("reset_to_baseline", {}, 0.0),
]

SCENARIO_STRUCT = T.StructType(
    [T.StructField("scenario_id", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in SCENARIO_LEVERS]
    + [T.StructField("cost", T.DoubleType()), T.StructField("scope_market", T.StringType()),
       T.StructField("scope_device", T.StringType()), T.StructField("scope_segment", T.StringType())]
)


def scenario_rows(scenarios: list[Scenario]) -> list[tuple]:
    return [(s.scenario_id, *[s.lever(n) for n in SCENARIO_LEVERS], None if s.cost is None else float(s.cost),
             s.market, s.device_type, s.engagement_segment) for s in scenarios]


def scenario_table(spark, scenarios: list[Scenario]) -> DataFrame:
    """The scenario parameter table (one row per scenario)."""
    return spark.createDataFrame(scenario_rows(scenarios), SCENARIO_STRUCT)


def _sql_literal(v, dtype: T.DataType) -> str:
    if v is None:
        return f"CAST(NULL AS {dtype.simpleString().upper()})"
    if isinstance(dtype, T.StringType):
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{float(v)!r}D"


def _literal_array(scenarios: list[Scenario]) -> Column:
    """The scenario list as one literal ``array<struct>`` (a single SQL expression, parsed once)."""
    structs = []
    for row in scenario_rows(scenarios):
        fields = ", ".join(f"'{f.name}', {_sql_literal(v, f.dataType)}" for v, f in zip(row, SCENARIO_STRUCT.fields))
        structs.append(f"named_struct({fields})")
    return F.expr(f"array({', '.join(structs)})")


@per_context
def lifted_drivers(p: str = "sc") -> dict[str, Column]:
    """C1 lever formulas as column expressions over the scenario struct ``p``."""
    lv = lambda n: F.col(f"{p}.{n}")
    fw, ai, trc, sub = lv("first_week_lift"), lv("app_install_lift"), lv("trc_usage_lift"), lv("sub_conversion_lift")
    ret, cpm, gm, risk = lv("retention_lift"), lv("cpm_lift"), lv("gross_margin_change"), lv("experience_risk_penalty")
    hours_drag = F.lit(RISK_TO_HOURS) * risk * cpm
    risk_drag = risk * (cpm + sub)
    multiplier = ((F.lit(1.0) + ret) * (F.lit(1.0) + F.lit(FIRST_WEEK_TO_RETENTION) * fw)
                  * (F.lit(1.0) + F.lit(APP_INSTALL_TO_RETENTION) * ai) * (F.lit(1.0) + F.lit(TRC_TO_RETENTION) * trc)
                  * (F.lit(1.0) - risk_drag))
    out = {
        "first_week_hours": F.col("first_week_hours") * (F.lit(1.0) + fw),
        "first_week_app_installs": F.col("first_week_app_installs") * (F.lit(1.0) + ai),
        "trc_usage_rate": clip(F.col("trc_usage_rate") * (F.lit(1.0) + trc), 0.0, 1.0),
        "monthly_streaming_hours": (F.col("monthly_streaming_hours") * (F.lit(1.0) + F.lit(TRC_TO_HOURS) * trc)
                                    * F.greatest(F.lit(0.0), F.lit(1.0) - hours_drag)),
        "subscription_conversion_rate": clip(F.col("subscription_conversion_rate") * (F.lit(1.0) + sub), 0.0, 1.0),
        "cpm": F.col("cpm") * (F.lit(1.0) + cpm),
        "gross_margin": clip(F.col("gross_margin") + gm, 0.0, SCENARIO_MARGIN_CAP),
    }
    for c in RETENTION_COLUMNS:
        out[c] = clip(F.col(c) * multiplier, 0.0, SCENARIO_RETENTION_CAP)
    return out


# baseline values carried through the fan-out for the same-pass comparison
CARRIED = {
    "b_clv": "discounted_clv", "b_tlv": "total_lifecycle_value", "b_m6": "month_6_retention",
    "b_rev": "total_monthly_revenue_per_household", "b_gp": "gross_profit_per_household",
    "b_months": "expected_retained_months", "b_ad": "ad_revenue_per_household",
    "b_hours": "monthly_streaming_hours", "b_fw": "first_week_hours",
}


def in_scope(columns: list[str], scenarios: list[Scenario], p: str = "sc") -> Column:
    """Row-in-scope predicate; a dimension absent from the table may only be left unscoped."""
    cond = F.lit(True)
    for col, key, attr in (("market", "scope_market", "market"), ("device_type", "scope_device", "device_type"),
                           ("engagement_segment", "scope_segment", "engagement_segment")):
        if col not in columns:
            if any(getattr(s, attr) is not None for s in scenarios):
                raise ValueError(f"scenario scope on {col!r} needs a scored table with that column")
            continue
        cond = cond & (F.col(f"{p}.{key}").isNull() | (F.col(col) == F.col(f"{p}.{key}")))
    return cond


def fan_out(baseline: DataFrame, scenarios: list[Scenario],
            annual_discount_rate: float = DEFAULT_DISCOUNT_RATE) -> DataFrame:
    """C1 batch form: one row per (cohort row in scope, scenario) with the CLV model re-run."""
    carried = [F.col(src).alias(dst) for dst, src in CARRIED.items()]
    b_mph = (F.col("total_monthly_revenue_per_household")
             / F.greatest(F.col("monthly_streaming_hours"), F.lit(1e-9))).alias("b_mph")
    x = baseline.select("*", *carried, b_mph, F.explode(_literal_array(scenarios)).alias("sc"))
    x = x.where(in_scope(baseline.columns, scenarios))
    x = x.withColumns(lifted_drivers())
    return run_clv_model(x, annual_discount_rate)


def _scope_of_table(columns: list[str], p: str = "sc") -> Column:
    """Row-in-scope predicate for a scenario table; a scope on a dimension that the rows lack raises an error."""
    cond = F.lit(True)
    for col, key in (("market", "scope_market"), ("device_type", "scope_device"), ("engagement_segment", "scope_segment")):
        wanted = F.col(f"{p}.{key}")
        met = F.col(col) == wanted if col in columns else F.raise_error(F.lit(f"a scenario is scoped on {col}, which the table lacks")).cast("boolean")
        cond = cond & F.when(wanted.isNull(), F.lit(True)).otherwise(met)
    return cond


def compare_scenario_table(baseline: DataFrame, scenarios: DataFrame,
                           annual_discount_rate: float = DEFAULT_DISCOUNT_RATE) -> DataFrame:
    """C2-C4 for a table of scenarios (the columns of ``SCENARIO_STRUCT``, distinct ids) of any length; nothing is collected.

    The scenarios are dealt by their id into blocks of about ``MAX_SCENARIOS_PER_PASS``, each one row with an array. Every
    baseline row meets every block through a join on the block number. ``BLOCKS_PER_PASS`` blocks at a time are
    broadcast, so the sent side has a bounded size; more blocks take more passes over the baseline. ``scenarios`` is
    read twice and should be a stored table.
    """
    n = scenarios.count()
    blocks = max(1, -(-n // MAX_SCENARIOS_PER_PASS))
    block = F.pmod(F.xxhash64("scenario_id"), F.lit(blocks)).cast("int")
    dealt = scenarios.select(block.alias("__block"), F.struct(*[f.name for f in SCENARIO_STRUCT.fields]).alias("sc"))
    dealt = dealt.groupBy("__block").agg(F.collect_list("sc").alias("__scenarios"))
    carried = [F.col(src).alias(dst) for dst, src in CARRIED.items()]
    b_mph = (F.col("total_monthly_revenue_per_household")
             / F.greatest(F.col("monthly_streaming_hours"), F.lit(1e-9))).alias("b_mph")
    parts = []
    for first in range(0, blocks, BLOCKS_PER_PASS):
        last = min(blocks, first + BLOCKS_PER_PASS) - 1
        rows = baseline.select("*", *carried, b_mph, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("__block"))
        sent = F.broadcast(dealt.where(F.col("__block").between(first, last)))
        x = rows.join(sent, "__block").withColumn("sc", F.explode("__scenarios")).drop("__block", "__scenarios")
        x = run_clv_model(x.where(_scope_of_table(baseline.columns)).withColumns(lifted_drivers()), annual_discount_rate)
        parts.append(_kpis_by_scenario(x))
    return with_comparison(_all(parts))


def _kpis_by_scenario(fanned: DataFrame) -> DataFrame:
    agg = fanned.groupBy(F.col("sc.scenario_id").alias("scenario_id"),
                         F.col("sc.cost").alias("initiative_cost")).agg(*_kpi_pair())
    return agg.where(F.col("households") > 0)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _wm(col: str) -> Column:
    return weighted_mean(col)


@per_context
def _kpi_pair() -> list[Column]:
    scen_mph = F.col("total_monthly_revenue_per_household") / F.greatest(F.col("monthly_streaming_hours"), F.lit(1e-9))
    return [
        F.sum("households").alias("households"),
        _wm("b_clv").alias("baseline_avg_clv"), _wm("discounted_clv").alias("scenario_avg_clv"),
        exact_sum("b_tlv").alias("baseline_total_lifecycle_value"),
        exact_sum("total_lifecycle_value").alias("scenario_total_lifecycle_value"),
        # summed per row: no cancellation between two large totals
        exact_sum(F.col("total_lifecycle_value") - F.col("b_tlv")).alias("incremental_value"),
        _wm("b_m6").alias("baseline_avg_month_6_retention"), _wm("month_6_retention").alias("scenario_avg_month_6_retention"),
        _wm("b_rev").alias("baseline_avg_revenue_per_household"),
        _wm("total_monthly_revenue_per_household").alias("scenario_avg_revenue_per_household"),
        _wm("b_gp").alias("baseline_avg_gross_profit_per_household"),
        _wm("gross_profit_per_household").alias("scenario_avg_gross_profit_per_household"),
        _wm("b_months").alias("baseline_avg_expected_retained_months"),
        _wm("expected_retained_months").alias("scenario_avg_expected_retained_months"),
        (exact_sum("b_ad", "households")
         / F.greatest(exact_sum("b_rev", "households"), F.lit(1e-9))).alias("baseline_ad_revenue_share"),
        (exact_sum("ad_revenue_per_household", "households")
         / F.greatest(exact_sum("total_monthly_revenue_per_household", "households"), F.lit(1e-9))
         ).alias("scenario_ad_revenue_share"),
        _wm("b_mph").alias("baseline_mph"),
        weighted_mean(scen_mph).alias("scenario_mph"),
        _wm("b_hours").alias("baseline_hours"), _wm("monthly_streaming_hours").alias("scenario_hours"),
        _wm("b_fw").alias("baseline_first_week_hours"), _wm("first_week_hours").alias("scenario_first_week_hours"),
    ]


def compare_scenarios(baseline: DataFrame, scenarios: list[Scenario],
                      annual_discount_rate: float = DEFAULT_DISCOUNT_RATE) -> DataFrame:
    """C2-C4 for every scenario in one pass (scenario lists beyond one pass are processed in chunks)."""
    parts = []
    for i in range(0, max(len(scenarios), 1), MAX_SCENARIOS_PER_PASS):
        chunk = scenarios[i:i + MAX_SCENARIOS_PER_PASS]
        if not chunk:
            break
        parts.append(_kpis_by_scenario(fan_out(baseline, chunk, annual_discount_rate)))
    return with_comparison(_all(parts))


def with_comparison(a: DataFrame) -> DataFrame:
    inc = F.col("incremental_value")
    cost = F.col("initiative_cost")
    has_cost = cost.isNotNull() & (cost > 0)
    monthly = inc / F.lit(float(CLV_HORIZON_MONTHS))
    m6_pts = (F.col("scenario_avg_month_6_retention") - F.col("baseline_avg_month_6_retention")) * F.lit(100.0)
    out = a.withColumns({
        "incremental_clv_per_household": F.col("scenario_avg_clv") - F.col("baseline_avg_clv"),
        "clv_lift_pct": F.when(F.col("baseline_avg_clv") != 0,
                               F.col("scenario_avg_clv") / F.col("baseline_avg_clv") - F.lit(1.0)).otherwise(F.lit(0.0)),
        "roi": F.when(has_cost, inc / cost),
        "payback_months": F.when(has_cost & (monthly > 0), cost / monthly),
        "never_pays_back": has_cost & (monthly <= 0),
        "month_6_retention_delta_pts": m6_pts,
        "mph_change_pct": F.when(F.col("baseline_mph") != 0, F.col("scenario_mph") / F.col("baseline_mph") - F.lit(1.0)),
        "streaming_hours_change_pct": F.when(F.col("baseline_hours") != 0,
                                             F.col("scenario_hours") / F.col("baseline_hours") - F.lit(1.0))
                                       .otherwise(F.lit(0.0)),
    })
    verdict = (F.when((F.col("incremental_value") > 0) & (F.col("month_6_retention_delta_pts") >= RETENTION_GUARDRAIL_PTS),
                      "Balanced")
               .when(F.col("incremental_value") > 0, "Guardrail flag")
               .when(F.col("scenario_mph") > F.col("baseline_mph") * F.lit(MPH_UP_FACTOR), "Net negative")
               .otherwise("Neutral"))
    return out.withColumn("verdict", verdict)


IMPACT_METRICS = [
    ("Avg CLV ($)", "avg_clv"),
    ("Revenue / HH / mo ($)", "avg_revenue_per_household"),
    ("Gross profit / HH / mo ($)", "avg_gross_profit_per_household"),
    ("Retained months", "avg_expected_retained_months"),
]


def scenario_impact(comparison: DataFrame) -> DataFrame:
    """C6 - 4 headline metrics x {baseline, scenario} in long form."""
    args = ", ".join(f"{i + 1}, '{label}', baseline_{k}, scenario_{k}" for i, (label, k) in enumerate(IMPACT_METRICS))
    return comparison.selectExpr("scenario_id", f"stack({len(IMPACT_METRICS)}, {args}) AS (position, metric, baseline, scenario)")


def lever_summary(scenarios: DataFrame) -> DataFrame:
    """C7 - the non-zero levers of each scenario with their labels."""
    long = scenarios.unpivot(["scenario_id"], SCENARIO_LEVERS, "lever", "value").where(F.col("value") != 0)
    labels = F.create_map(*[x for k, v in LEVER_LABELS.items() for x in (F.lit(k), F.lit(v))])
    pos = F.create_map(*[x for i, k in enumerate(SCENARIO_LEVERS) for x in (F.lit(k), F.lit(i + 1))])
    return long.select("scenario_id", pos[F.col("lever")].alias("position"), "lever",
                       labels[F.col("lever")].alias("label"), "value")
