"""Query catalogue: every registered query as ``(spark, sf_dir) -> DataFrame``.

Each query reads the driver's fact tables (through the memoised baseline) so
its work grows with the data. Floating outputs are rounded half-even to 6 dp
for the oracle comparison (``finalize``); that is presentation only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.numeric import rint_round, weighted_mean
import os

from cohortlens.operators import contexts, grounding, insights, portfolio, scenario, terms, totals, verify, views
from cohortlens.operators import monetization as mon
from cohortlens.operators import quality, segments, value
from cohortlens.operators.scenario import Scenario
from cohortlens.sources.files import read_initiatives_csv, share_upload
from cohortlens.operators.ranks import with_percentile_ranks
from cohortlens.plans.baseline import baseline_table, fingerprint
from cohortlens.schema import DEFAULT_ACQUISITION_COST, DEFAULT_DISCOUNT_RATE, KEY_COLUMNS
from cohortlens.session import materialize
from cohortlens.sources.facts import cohorts_from_facts

RATE = DEFAULT_DISCOUNT_RATE
CAC = DEFAULT_ACQUISITION_COST


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column half-even (numpy style) for engine-independent comparison."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(rint_round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _base(spark: SparkSession, sf: str) -> DataFrame:
    return baseline_table(spark, sf)


# ------------------------------------------------------------- sources ----

def q_cohort_table(spark, sf):
    """S6 - the cohort table built from orders/lineitem/customer/nation/region."""
    return finalize(cohorts_from_facts(spark, sf))


def q_quality_issues(spark, sf):
    """V2, V4-V7 - issue counts of the cohort table, one aggregate, long form."""
    return quality.issue_counts_long(cohorts_from_facts(spark, sf))


def inject_faults(cohorts: DataFrame) -> DataFrame:
    """Dirty stand-in input for the validation job: deterministic faults keyed on the cohort keys.

    Missing activation (January cohorts), NaN fill rate (June), TRC above 1
    (BUILDING), negative CPM (MACHINERY in ASIA), retention above 1 (December),
    negative households (AFRICA in March). Only values change; every row stays.
    """
    month = F.substring("cohort_month", 6, 2)
    return cohorts.withColumns({
        "activation_rate": F.when(month == "01", F.lit(None).cast("double")).otherwise(F.col("activation_rate")),
        "fill_rate": F.when(month == "06", F.lit(float("nan"))).otherwise(F.col("fill_rate")),
        "trc_usage_rate": F.when(F.col("device_type") == "BUILDING", F.col("trc_usage_rate") + 1.0)
                           .otherwise(F.col("trc_usage_rate")),
        "cpm": F.when((F.col("device_type") == "MACHINERY") & (F.col("region") == "ASIA"), -F.col("cpm"))
                .otherwise(F.col("cpm")),
        "month_12_retention": F.when(month == "12", F.col("month_12_retention") + 1.0)
                               .otherwise(F.col("month_12_retention")),
        "households": F.when((F.col("region") == "AFRICA") & (month == "03"), -F.col("households"))
                       .otherwise(F.col("households")),
    })


def q_quality_issues_injected(spark, sf):
    """V2, V4-V7 on a cohort table with injected nulls, NaN, out-of-range and negative values."""
    return quality.issue_counts_long(inject_faults(cohorts_from_facts(spark, sf)))


def q_cleaned_injected(spark, sf):
    """V3-V5 - the rows that stay of the faulty cohort table, rates and non-negative drivers clipped."""
    return finalize(quality.validate(inject_faults(cohorts_from_facts(spark, sf))).clean)


def q_issue_records_injected(spark, sf):
    """V2, V4-V7 - the ordered issue records of the faulty cohort table, with their messages."""
    return quality.validate(inject_faults(cohorts_from_facts(spark, sf))).issues


def q_issue_records_empty(spark, sf):
    """V7 with V2 - the issue records of a cohort table of which no row is complete."""
    nothing = cohorts_from_facts(spark, sf).withColumn("fill_rate", F.lit(None).cast("double"))
    return quality.validate(nothing).issues


def q_dataset_created_once(spark, sf):
    """S2 - rows and households by region of a dataset that is made where it is absent, and not made again."""
    from cohortlens.session import table_path
    from cohortlens.sources.files import ensure_dataset
    import uuid
    path = table_path(spark, f"dataset_{uuid.uuid4().hex}")
    ensure_dataset(spark, path, lambda s: cohorts_from_facts(s, sf))
    again = ensure_dataset(spark, path, lambda s: cohorts_from_facts(s, sf).where("region = 'ASIA'"))
    return again.groupBy("region").agg(F.count("*").alias("cohort_rows"), F.sum("households").alias("households"))


def q_dataset_rebuilt(spark, sf):
    """S2 - a dataset that a lost driver left without its success marker is built again."""
    from cohortlens.session import table_path
    from cohortlens.sources.files import ensure_dataset
    import uuid
    path = table_path(spark, f"dataset_{uuid.uuid4().hex}")
    cohorts_from_facts(spark, sf).where("region = 'ASIA'").write.parquet(path)
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    marker.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(marker, False)
    built = ensure_dataset(spark, path, lambda s: cohorts_from_facts(s, sf))
    return built.groupBy("region").agg(F.count("*").alias("cohort_rows"), F.sum("households").alias("households"))


def q_partitions_replaced(spark, sf):
    """S7 - the cohort table by region, of which two regions are replaced and the others stay."""
    from cohortlens.session import table_path
    from cohortlens.sources.files import write_results
    import uuid
    path = table_path(spark, f"results_{uuid.uuid4().hex}")
    cohorts = cohorts_from_facts(spark, sf)
    write_results(cohorts, path, partition_by=["region"], rows_per_file=1000)
    again = cohorts.where("region IN ('ASIA', 'EUROPE')").withColumn("households", F.col("households") * 2)
    write_results(again, path, partition_by=["region"], touched_only=True)
    return spark.read.parquet(path).groupBy("region").agg(F.count("*").alias("cohort_rows"), F.sum("households").alias("households"))


def _malformed_csv(spark, sf) -> str:
    """The cohort table as CSV text in which African rows have two cells too many and European ones end after the market."""
    from cohortlens.schema import REQUIRED_COLUMNS
    from cohortlens.session import table_path
    import uuid
    path = table_path(spark, f"malformed_{uuid.uuid4().hex}")
    cells = F.concat_ws(",", *[F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')) for c in REQUIRED_COLUMNS])
    cells = F.when(F.col("region") == "AFRICA", F.concat(cells, F.lit(',"x,y",z'))).when(
        F.col("region") == "EUROPE", F.concat_ws(",", F.col(REQUIRED_COLUMNS[0]), F.col(REQUIRED_COLUMNS[1]))).otherwise(cells)
    rows = cohorts_from_facts(spark, sf).select(cells.alias("value"))
    # files with a header each: as many as the session has shuffle partitions
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    head = spark.range(files).select(F.col("id").alias("file"), F.lit(0).alias("at"), F.lit(",".join(REQUIRED_COLUMNS)).alias("value"))
    body = rows.select(F.pmod(F.xxhash64("value"), F.lit(files)).alias("file"), F.lit(1).alias("at"), "value")
    lines = head.unionByName(body).repartition("file").sortWithinPartitions("file", "at")
    lines.select("file", "value").write.partitionBy("file").text(path)
    return f"{path}/file=*"


def q_cohort_csv_rejected(spark, sf):
    """S1 - rows of a CSV by what became of them: rejected with their reason, or read as complete or not."""
    from cohortlens.sources.files import read_cohort_csv, rejected_rows
    path = _malformed_csv(spark, sf)
    rejected = rejected_rows(spark, path, line_breaks=False).select(F.col("reason").alias("outcome"))
    read = read_cohort_csv(spark, path, line_breaks=False)
    read = read.select(F.when(F.col("cpm").isNull(), "incomplete").otherwise("complete").alias("outcome"))
    return rejected.unionByName(read).groupBy("outcome").agg(F.count("*").alias("n_rows"))


def q_partitioned_results(spark, sf):
    """S7 - the cohort table written as Parquet by region, one region read back by its partition."""
    from cohortlens.session import table_path
    from cohortlens.sources.files import read_cohort_parquet, write_results
    import uuid
    path = table_path(spark, f"results_{uuid.uuid4().hex}")
    cohorts = cohorts_from_facts(spark, sf)
    write_results(cohorts, path, partition_by=["region"])
    return finalize(read_cohort_parquet(spark, path).where(F.col("region") == "ASIA").select(*cohorts.columns))


def q_cohort_csv_roundtrip(spark, sf):
    """S7 -> S1: the cohort table written as CSV to the shared folder, read back typed, then A4 KPIs."""
    from cohortlens.session import table_path
    from cohortlens.sources.files import read_cohort_csv, write_results
    from cohortlens.operators.quality import validate as _validate
    import uuid
    path = table_path(spark, f"cohort_csv_{uuid.uuid4().hex}")
    write_results(cohorts_from_facts(spark, sf), path, fmt="csv")
    back = read_cohort_csv(spark, path)  # counts come back as DOUBLE; those written here are whole
    v = _validate(back.withColumn("households", F.col("households").cast("bigint")))
    return finalize(value.portfolio_kpis(value.run_clv_model(v.clean, RATE), acquisition_cost=CAC))


# ---------------------------------------------------------------- value ----

def q_clv_detail(spark, sf):
    """P1-P9, P18 - auditable per-cohort CLV detail (rounded to 2 dp like the audit view)."""
    b = _base(spark, sf)
    cols = [F.col(c) for c in KEY_COLUMNS] + [F.col("engagement_segment"), F.col("households")]
    cols += [rint_round(c, 2).alias(c) for c in value.AUDIT_COLUMNS[5:]]
    cols += [rint_round(c, 6).alias(c) for c in ("total_lifecycle_value",)]
    return b.select(*cols)


def q_survival_long(spark, sf):
    """P5 - the 24-month survival curve per cohort row, long form."""
    return finalize(value.survival_long(_base(spark, sf), KEY_COLUMNS))


def q_kpis(spark, sf):
    """A4 + P10-P12 - portfolio KPIs with net CLV, CLV:CAC and the underwater flag (CAC 8)."""
    return finalize(value.portfolio_kpis(_base(spark, sf), acquisition_cost=CAC))


def q_kpis_by_market_device(spark, sf):
    """A4 grouped by market x device, with unit economics."""
    return finalize(value.portfolio_kpis(_base(spark, sf), by=["market", "device_type"], acquisition_cost=CAC))


def q_walkthrough(spark, sf):
    """A13 - average household through the model (ordered steps)."""
    return finalize(value.walkthrough(_base(spark, sf), CAC, RATE))


def q_revenue_mix(spark, sf):
    """A14 - ad vs subscription revenue share."""
    return finalize(value.revenue_mix(_base(spark, sf)))


def q_payback(spark, sf):
    """A5 - portfolio payback month at CAC 8."""
    return finalize(value.payback_month(_base(spark, sf), CAC, RATE))


def q_payback_by_market_device(spark, sf):
    """A5 grouped by market x device."""
    return finalize(value.payback_month(_base(spark, sf), CAC, RATE, by=["market", "device_type"]))


OTHER_RATE, OTHER_CAC = 0.15, 12.5
OTHER_WEIGHTS = (0.4, 0.3, 0.2, 0.1)
#: Small, so that the ranges and the shuffled join are used at every scale.
HOUSEHOLDS_PER_BUCKET = 500


def q_kpis_other_terms(spark, sf):
    """A4 + P10-P12 by market at a discount rate of 15 % and an acquisition cost of 12.50."""
    b = baseline_table(spark, sf, annual_discount_rate=OTHER_RATE)
    return finalize(value.portfolio_kpis(b, by=["market"], acquisition_cost=OTHER_CAC))


def q_payback_other_terms(spark, sf):
    """A5 by device type at a discount rate of 15 % and an acquisition cost of 12.50."""
    b = baseline_table(spark, sf, annual_discount_rate=OTHER_RATE)
    return finalize(value.payback_month(b, OTHER_CAC, OTHER_RATE, by=["device_type"]))


GRID_RATES = [round(0.01 * i, 2) for i in range(25)]
GRID_COSTS = [0.5 * i for i in range(40)]


def q_unit_economics_grid(spark, sf):
    """P8, P10-P12, A4, A5 - 25 discount rates by 40 acquisition costs from one scan of the baseline."""
    return finalize(terms.terms_grid(_base(spark, sf), GRID_RATES, GRID_COSTS))


def q_unit_economics_grid_by_market(spark, sf):
    """P8, P10-P12, A4, A5 by market at three rates and four costs."""
    return finalize(terms.terms_grid(_base(spark, sf), [0.0, 0.08, 0.3], [-1.0, 0.0, 6.25, 1000.0], by=["market"]))


def row_rate() -> F.Column:
    """A discount rate for each cohort: 5 % and a percent for each calendar month."""
    return F.lit(0.05) + F.substring("cohort_month", 6, 2).cast("int") / F.lit(100.0)


def _raw_cohorts(spark, sf) -> DataFrame:
    return _base(spark, sf).drop(*value.CLV_COLUMNS)


def q_clv_row_rates(spark, sf):
    """P8 with a discount rate per row - lifetime value of every cohort."""
    out = value.run_clv_model(_raw_cohorts(spark, sf), row_rate())
    return finalize(out.select(*KEY_COLUMNS, "discounted_clv", "total_lifecycle_value"))


def q_exact_totals(spark, sf):
    """A1 for every double - line amounts that stand among others of 1e25 times their size, which cancel, and 1e-13 times it."""
    price = F.col("l_extendedprice")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("long").alias("n"),
        F.concat(price.cast("decimal(18,2)").cast("string"), F.lit("E-13")).cast("double").alias("tiny"),
        F.explode(F.array(price, price * 1e25, price * -1e25)).alias("amount"))
    out = totals.exact_totals(lines, {"amount": "amount", "by_number": ("amount", "n"), "tiny": ("tiny", "n"), "n": "n"}, ["l_returnflag", "l_linestatus"])
    return finalize(out.select("l_returnflag", "l_linestatus", "amount", "by_number", (F.col("tiny") / F.col("n") * 1e13).alias("tiny_mean")))


MEANS = ["month_1_retention", "month_12_retention", "gross_margin", "total_monthly_revenue_per_household", "discounted_clv"]


def q_exact_weighted_means(spark, sf):
    """A1 - household-weighted means by market from totals by decimal exponent."""
    return finalize(totals.exact_weighted_means(_base(spark, sf), MEANS, by=["market"]))


def q_payback_row_rates(spark, sf):
    """A4, A5 with a discount rate per row - average lifetime value and payback month by market."""
    b = value.run_clv_model(_raw_cohorts(spark, sf), row_rate())
    kpis = value.portfolio_kpis(b, by=["market"], acquisition_cost=CAC).select("market", "avg_clv", "net_clv", "underwater")
    return finalize(value.payback_month(b, CAC, row_rate(), by=["market"]).join(kpis, "market"))


def q_household_scores(spark, sf):
    """W1-W7 at household grain: every customer is a cohort of one, ranked by value ranges and the long-form join."""
    from cohortlens.plans.baseline import build_baseline
    b = build_baseline(cohorts_from_facts(spark, sf, per_household=True), RATE, rows_per_bucket=HOUSEHOLDS_PER_BUCKET,
                       broadcast_rows=0).table
    return finalize(b.select("custkey", *KEY_COLUMNS, "discounted_clv", "engagement_score", "engagement_segment",
                             "monetization_depth_score", "experience_health_score", "balanced_value_score"))


def q_engagement_segments_weighted(spark, sf):
    """W1-W3 with engagement weights of 0.4, 0.3, 0.2 and 0.1."""
    b = baseline_table(spark, sf, weights=OTHER_WEIGHTS)
    return finalize(b.select(*KEY_COLUMNS, "engagement_score", "engagement_segment"))


# ------------------------------------------------------------ segments ----

def q_engagement_segments(spark, sf):
    """W1-W3 - engagement score and tercile segment per cohort row."""
    b = _base(spark, sf)
    return finalize(b.select(*KEY_COLUMNS, "engagement_score", "engagement_segment"))


TIE_WEIGHTS = (0.0, 1.0, 0.0, 0.0)


def q_engagement_segments_ties(spark, sf):
    """W4 - the rank-based tercile fallback.

    Stand-in input: installs counted in blocks of four (``floor(x / 4)``) and
    an installs-only weighting; the lowest block holds over a third of the
    rows, so the 1/3 quantile equals the minimum score and the rank-based cut
    takes over.
    """
    from cohortlens.plans.baseline import build_baseline_cached
    c = cohorts_from_facts(spark, sf).withColumn(
        "first_week_app_installs", F.floor(F.col("first_week_app_installs") / 4.0).cast("double"))
    b = build_baseline_cached(("ties", fingerprint(spark, sf)), c, RATE, TIE_WEIGHTS)
    return finalize(b.select(*KEY_COLUMNS, "first_week_app_installs", "engagement_score", "engagement_segment"))


def _summary(by):
    def q(spark, sf):
        return finalize(segments.segment_summary(_base(spark, sf), by))
    q.__doc__ = f"A2 - household-weighted segment summary by {by}."
    return q


def q_value_segments(spark, sf):
    """A3 - top-3 and bottom-3 markets by average CLV, with their positions."""
    return finalize(segments.value_segments(_base(spark, sf), 3))


def q_segment_summaries(spark, sf):
    """A2 for segment/market/device/month/region in one GROUPING SETS job."""
    dims = ["engagement_segment", "market", "device_type", "cohort_month", "region"]
    return finalize(segments.segment_summaries(_base(spark, sf), dims))


# -------------------------------------------------------- monetization ----

def q_monetization_scores(spark, sf):
    """P13-P16, W5-W7 - monetization ratios and scores per cohort row."""
    b = _base(spark, sf)
    return finalize(b.select(*KEY_COLUMNS, "revenue_per_household", "monetization_per_streaming_hour",
                             "ad_revenue_share", "subscription_revenue_share", "monetization_depth_score",
                             "experience_health_score", "balanced_value_score"))


def q_monetization_by_market(spark, sf):
    """A6 by market."""
    return finalize(mon.monetization_summary(_base(spark, sf), "market"))


def q_monetization_by_device(spark, sf):
    """A6/A15 by device type."""
    return finalize(mon.monetization_summary(_base(spark, sf), "device_type"))


def q_guardrail_segments(spark, sf):
    """A7 - under-monetized / experience-risk / best-balanced lists (top 5 each)."""
    g = mon.guardrail_segments(_base(spark, sf))
    return finalize(g.select("list", "segment", "households", *[n for n, _ in mon.MONETIZATION_SUMMARY],
                             "gap", "list_gap", "position"))


def q_monetization_kpis(spark, sf):
    """A8 - portfolio monetization KPIs and list heads."""
    return finalize(mon.portfolio_monetization_kpis(_base(spark, sf)))


# ---------------------------------------------------------------- views ----

def q_coverage(spark, sf):
    """A9 - dataset coverage by market and region (unweighted means, 2 dp)."""
    return finalize(views.coverage(_base(spark, sf)))


def q_cardinalities(spark, sf):
    """A10 - rows and distinct markets / months / devices."""
    return views.cardinalities(_base(spark, sf))


def q_retention_curves(spark, sf):
    """A11 - weighted retention curve per engagement segment (long form)."""
    return finalize(views.retention_curves(_base(spark, sf)))


def q_headline_gaps(spark, sf):
    """A12 - High vs Low CLV premium and m6 gap, top market share of value."""
    return finalize(views.headline_gaps(_base(spark, sf)))


def q_score_grid(spark, sf):
    """A17 - depth x health score grid (5-point bins) with quadrant labels and weights."""
    return finalize(views.score_grid(_base(spark, sf)))


def q_score_points(spark, sf):
    """A17 - row-level score/value points with quadrant labels."""
    return finalize(views.score_points(_base(spark, sf)))


def q_engagement_clv_grid(spark, sf):
    """A17 - engagement score x CLV points counted in cells of 0.05 and 5 dollars."""
    return finalize(views.point_grid(_base(spark, sf), "engagement_score", "discounted_clv", 20, 0.2))


def q_depth_clv_grid(spark, sf):
    """A17 - monetization depth x CLV points counted in cells of 5 points and 5 dollars."""
    return finalize(views.point_grid(_base(spark, sf), "monetization_depth_score", "discounted_clv", 0.2, 0.2))


def q_yield_by_market(spark, sf):
    """A15 - monetization yield per hour by market (ascending)."""
    return finalize(views.yield_by(_base(spark, sf), "market"))


def q_yield_by_device(spark, sf):
    """A15 - monetization yield per hour by device type (ascending)."""
    return finalize(views.yield_by(_base(spark, sf), "device_type"))


def q_clv_by_cohort(spark, sf):
    """A16 - CLV by cohort month in month order."""
    return finalize(views.clv_by_cohort(_base(spark, sf)))


FILTER_REGIONS = ["AMERICA", "EUROPE"]
FILTER_SEGMENTS = ["High", "Medium"]


def q_filtered_kpis(spark, sf):
    """F1 - KPIs on a region x engagement-segment multi-select (filters after global scoring)."""
    v = views.filter_cohorts(_base(spark, sf), regions=FILTER_REGIONS, segments=FILTER_SEGMENTS)
    return finalize(value.portfolio_kpis(v, acquisition_cost=CAC))


def q_scoped_walkthrough(spark, sf):
    """F2 + A13 - average household walkthrough for every market x device scope."""
    b = _base(spark, sf)
    a = b.groupBy("market", "device_type").agg(
        *[weighted_mean(c).alias(c) for c in (
            "ad_revenue_per_household", "subscription_revenue_per_household", "total_monthly_revenue_per_household",
            "gross_margin", "support_cost_per_household", "gross_profit_per_household", "expected_retained_months",
            "baseline_clv", "discounted_clv")]).withColumn("net_clv", F.col("discounted_clv") - F.lit(CAC))
    return finalize(a)


FILTER_MARKETS = ["NATION_1", "NATION_3", "NATION_7", "NATION_12"]
FILTER_DEVICES = ["BUILDING", "MACHINERY"]
FILTER_MONTHS = ["1995-01", "1995-02", "1995-04"]


def q_filtered_kpis_markets(spark, sf):
    """F1 - KPIs on a market x device x cohort-month multi-select."""
    v = views.filter_cohorts(_base(spark, sf), markets=FILTER_MARKETS, devices=FILTER_DEVICES, cohorts=FILTER_MONTHS)
    return finalize(value.portfolio_kpis(v, acquisition_cost=CAC))


def q_walkthrough_scope(spark, sf):
    """F2 + A13 - the average household of one market and device."""
    return finalize(value.walkthrough(views.scope(_base(spark, sf), market="NATION_3", device="BUILDING"), CAC, RATE))


# ------------------------------------------------------------ scenarios ----

SCOPED_SCENARIOS = [
    Scenario("cpm20_risk30_all", {"cpm_lift": 0.20, "experience_risk_penalty": 0.30}),
    Scenario("monetization_push_nation3_high", {"cpm_lift": 0.10, "sub_conversion_lift": 0.15}, 600_000.0,
             market="NATION_3", engagement_segment="High"),
    Scenario("onboarding_building", {"first_week_lift": 0.15, "app_install_lift": 0.10}, 750_000.0,
             device_type="BUILDING"),
    Scenario("retention_margin_nation7_machinery_low", {"retention_lift": 0.10, "gross_margin_change": -0.02},
             250_000.0, market="NATION_7", device_type="MACHINERY", engagement_segment="Low"),
    Scenario("trc_push_low", {"trc_usage_lift": 0.30, "experience_risk_penalty": 0.5}, 400_000.0,
             engagement_segment="Low"),
    Scenario("empty_scope", {"retention_lift": 0.05}, 100_000.0, market="NO_SUCH_MARKET"),
]


def verdict_grid() -> list[Scenario]:
    out = []
    for cpm in (0.0, 0.1, 0.2, 0.35, 0.5):
        for risk in (0.0, 0.3, 0.6, 1.0):
            for sub in (0.0, 0.15):
                out.append(Scenario(f"cpm{cpm}_risk{risk}_sub{sub}",
                                    {"cpm_lift": cpm, "experience_risk_penalty": risk, "sub_conversion_lift": sub},
                                    500_000.0))
    return out


COMPARE_COLUMNS = ["scenario_id", "initiative_cost", "households", "baseline_avg_clv", "scenario_avg_clv",
                   "baseline_total_lifecycle_value", "scenario_total_lifecycle_value",
                   "baseline_avg_month_6_retention", "scenario_avg_month_6_retention",
                   "baseline_avg_revenue_per_household", "scenario_avg_revenue_per_household",
                   "baseline_avg_gross_profit_per_household", "scenario_avg_gross_profit_per_household",
                   "baseline_avg_expected_retained_months", "scenario_avg_expected_retained_months",
                   "baseline_ad_revenue_share", "scenario_ad_revenue_share", "baseline_mph", "scenario_mph",
                   "baseline_hours", "scenario_hours", "incremental_value", "incremental_clv_per_household",
                   "clv_lift_pct", "roi", "payback_months", "never_pays_back", "month_6_retention_delta_pts",
                   "mph_change_pct", "streaming_hours_change_pct", "verdict"]


def q_scenario_presets(spark, sf):
    """C1-C5 - the preset scenarios on all households, compared with the baseline."""
    return finalize(scenario.compare_scenarios(_base(spark, sf), scenario.PRESETS, RATE).select(*COMPARE_COLUMNS))


def q_scenario_scoped(spark, sf):
    """F3 + C1-C4 - scenarios with market / device / segment scopes (an empty scope yields no row)."""
    return finalize(scenario.compare_scenarios(_base(spark, sf), SCOPED_SCENARIOS, RATE).select(*COMPARE_COLUMNS))


def q_scenario_verdicts(spark, sf):
    """C1-C4 - a 40-scenario CPM x risk x subscription grid in one fan-out job, with verdicts."""
    c = scenario.compare_scenarios(_base(spark, sf), verdict_grid(), RATE)
    return finalize(c.select("scenario_id", "households", "incremental_value", "month_6_retention_delta_pts",
                             "baseline_mph", "scenario_mph", "roi", "payback_months", "never_pays_back", "verdict"))


def q_scenario_impact(spark, sf):
    """C6 - baseline vs scenario on the four headline metrics for the presets."""
    return finalize(scenario.scenario_impact(scenario.compare_scenarios(_base(spark, sf), scenario.PRESETS, RATE)))


def q_scenario_levers(spark, sf):
    """C7 - non-zero levers per preset scenario with their labels, next to the modeled value."""
    levers = scenario.lever_summary(scenario.scenario_table(spark, scenario.PRESETS))
    cmp = scenario.compare_scenarios(_base(spark, sf), scenario.PRESETS, RATE).select("scenario_id", "incremental_value")
    return finalize(levers.join(cmp, "scenario_id"))


# ----------------------------------------------------------- initiatives ----

def q_initiative_ranking(spark, sf):
    """I1-I9 - preset initiatives through the scenario engine, scored, ranked, classified."""
    return finalize(portfolio.score_initiatives(_base(spark, sf), None, RATE).drop("thesis"))


UPLOAD_CSV = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))),
                          "tests", "fixtures", "initiatives_upload.csv")


def q_initiative_ranking_uploaded(spark, sf):
    """S5 + I1-I9 - an uploaded initiative CSV (BOM, no retention_risk column, blanks) ranked."""
    ini = read_initiatives_csv(spark, share_upload(spark, UPLOAD_CSV))
    return finalize(portfolio.score_initiatives(_base(spark, sf), ini, RATE).drop("thesis"))


INITIATIVE_CHANGES = [
    ("Onboarding Optimization", 0.30, None, 900_000.0, None, None),
    (" Ad Monetization Optimization ", None, 0.2, None, 5.0, False),
    ("Win-back / Reactivation Campaign", None, None, None, None, True),
    ("Partner Bundles", 0.05, 0.04, 0.0, 1.0, None),
    ("Never Planned", None, None, None, None, True),
]


def q_initiative_ranking_edited(spark, sf):
    """S5 + I1-I9 - the preset initiatives after rows were changed, removed and added, ranked."""
    changes = spark.createDataFrame(INITIATIVE_CHANGES, "initiative string, first_week_lift double, cpm_lift double, cost double, complexity double, removed boolean")
    edited = portfolio.edit_initiatives(portfolio.initiatives_table(spark), changes)
    return finalize(portfolio.score_initiatives(_base(spark, sf), edited, RATE).drop("thesis"))


def q_roadmap(spark, sf):
    """I10 - Now / Next / Foundational buckets in rank order."""
    return finalize(portfolio.roadmap(portfolio.score_initiatives(_base(spark, sf), None, RATE)))


def q_impact_complexity(spark, sf):
    """I11 + I12 - impact vs complexity points and the top-ranked initiative."""
    ranked = portfolio.score_initiatives(_base(spark, sf), None, RATE)
    return finalize(portfolio.impact_complexity(ranked))


# ------------------------------------------------------------- insights ----

def q_under_monetized(spark, sf):
    """G1 - the largest under-monetized engaged pocket."""
    return finalize(insights.under_monetized(_base(spark, sf)))


def q_vintage_trend(spark, sf):
    """G2 - newest vs oldest cohorts and the driver of the move."""
    return finalize(insights.vintage_trend(_base(spark, sf)))


def q_marginal_retention(spark, sf):
    """G3 - where the next retention point pays most."""
    return finalize(insights.marginal_retention(_base(spark, sf), RATE))


def q_marginal_retention_by_market(spark, sf):
    """G3 per market: CLV per household per +1 % retention."""
    return finalize(insights.marginal_retention_by_market(_base(spark, sf), RATE))


def q_gap_insights(spark, sf):
    """G4 - all gap insights as tidy rows."""
    return finalize(gap_insights_for(_base(spark, sf)))


# ------------------------------------------------------------- grounding ----

def overview_facts(b: DataFrame) -> DataFrame:
    """N1 + G4 overview context, materialised once per baseline (it feeds several verification jobs)."""
    key = id(b)
    hit = _FACTS.get(key)
    if hit is None or hit[0] is not b:
        facts = grounding.base_facts(b, "overview").unionByName(
            grounding.insight_facts(gap_insights_for(b), "overview"))
        hit = (b, materialize(facts, "overview_facts"))
        _FACTS[key] = hit
    return hit[1]


_FACTS: dict[int, tuple] = {}
_INSIGHTS: dict[int, tuple] = {}


def gap_insights_for(b: DataFrame) -> DataFrame:
    """G4 for a baseline, materialised once (the overview page and the grounding context both read it)."""
    hit = _INSIGHTS.get(id(b))
    if hit is None or hit[0] is not b:
        hit = (b, materialize(insights.gap_insights(b, RATE), "gap_insights"))
        _INSIGHTS[id(b)] = hit
    return hit[1]


def drivers_facts(b: DataFrame) -> DataFrame:
    """N3 from the materialised overview context: its N1 part relabelled, plus the revenue mix."""
    base = (overview_facts(b).where(~F.col("path").startswith("gap_insights_non_obvious."))
            .withColumn("context_id", F.lit("drivers")))
    mix = value.portfolio_kpis(b).select(
        rint_round("ad_revenue_share", 3).alias("ad_revenue_share"),
        rint_round(F.lit(1.0) - F.col("ad_revenue_share"), 3).alias("subscription_revenue_share"))
    return base.unionByName(grounding.record_facts(mix, "drivers", "revenue_mix", None))


def q_grounding_facts(spark, sf):
    """N1-N3, N5 - overview (KPIs, summaries, gap insights), cohort view, drivers and guardrail contexts."""
    b = _base(spark, sf)
    view = views.filter_cohorts(b, regions=FILTER_REGIONS)
    parts = [overview_facts(b),
             grounding.cohort_facts(view, "cohort_view", {"region": FILTER_REGIONS}),
             drivers_facts(b),
             grounding.guardrail_facts(b, "guardrails")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return finalize(out)


def q_grounding_facts_planning(spark, sf):
    """N4, N6, N7 - scenario read-out, initiative ranking and executive memo contexts."""
    b = _base(spark, sf)
    onboarding = scenario.PRESETS[0]
    cmp = scenario.compare_scenarios(b, [onboarding], RATE)
    ranked = portfolio.score_initiatives(b, None, RATE)
    parts = [grounding.scenario_facts(cmp, onboarding.scenario_id, onboarding.levers, "All households", "scenario"),
             grounding.ranking_facts(ranked, "ranking"),
             grounding.memo_facts(b, ranked, gap_insights_for(b), "memo", grounding.active_scenario_facts(
                 cmp, onboarding.scenario_id, onboarding.levers, "All households", "memo"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return finalize(out)


def market_drafts(b: DataFrame) -> DataFrame:
    """Draft texts quoting per-market figures (some traceable to the overview context, some derived)."""
    m = segments.segment_summary(b, "market")
    fmt = ("%s: %s households, average CLV $%.2f, month-6 retention %.1f%%, revenue $%.2f per household per month, "
           "lifecycle value $%.1fK and a %.1fx CLV-to-CAC ratio over %.1f months.")
    text = F.format_string(
        fmt, F.col("market"), F.format_number(F.col("households"), 0), rint_round("avg_clv", 2),
        rint_round(F.col("avg_month_6_retention") * 100.0, 1), rint_round("avg_monthly_revenue", 2),
        rint_round(F.col("total_lifecycle_value") / 1000.0, 1), rint_round(F.col("avg_clv") / CAC, 1),
        rint_round(F.col("avg_first_week_hours"), 1))
    return m.select(F.concat(F.lit("market:"), F.col("market")).alias("draft_id"),
                    F.lit("overview").alias("context_id"), text.alias("text"))


def q_draft_figures(spark, sf):
    """N8-N9 - the figures quoted in the per-market drafts, parsed with their tolerances."""
    figs = verify.parse_figures(verify.extract_figures(market_drafts(_base(spark, sf)), ["draft_id"]))
    return finalize(figs.select("draft_id", "pos", "raw", "value", "tol"))


def _verified(v: DataFrame) -> DataFrame:
    return v.withColumn("unverified", F.array_join("unverified", " | "))


def q_figure_verification(spark, sf):
    """N8-N15 - per-market drafts checked against the overview grounding context."""
    b = _base(spark, sf)
    return _verified(verify.verify_drafts(market_drafts(b), overview_facts(b)))


def market_contexts(b: DataFrame) -> DataFrame:
    """A nested JSON context per market: its summary, a list of devices with notes and flags, and two KPI sets."""
    three = lambda c: rint_round(c, 3)
    summary = segments.segment_summary(b, "market").select(
        "market", F.struct("households", three("avg_clv").alias("avg_clv"), F.struct(
            three("avg_month_6_retention").alias("month_6"), three("avg_monthly_revenue").alias("revenue")).alias("rates")).alias("summary"),
        F.struct(three("avg_clv").alias("avg_clv")).alias("baseline_kpis"), F.struct(three(F.col("avg_clv") * 1.1).alias("avg_clv")).alias("scenario_kpis"))
    device = b.groupBy("market", "device_type").agg(*segments.summary_aggs())
    note = F.format_string("kept %.1f%% over %s households", rint_round(F.col("avg_month_6_retention") * 100.0, 1), F.format_number("households", 0))
    devices = device.groupBy("market").agg(F.array_sort(F.collect_list(F.struct(
        "device_type", F.array(F.array(three("avg_clv")), F.array(three("avg_first_week_hours"))).alias("values"), note.alias("note"),
        (F.col("households") > 10).alias("large"), F.lit(None).cast("double").alias("open")))).alias("devices"))  # one entry per device type
    return summary.join(devices, "market").select(F.concat(F.lit("market:"), F.col("market")).alias("context_id"), F.to_json(
        F.struct("market", "summary", "devices", "baseline_kpis", "scenario_kpis"), {"ignoreNullFields": "false"}).alias("context"))


def q_nested_context_verification(spark, sf):
    """N10 with N8-N15 - the per-market drafts, each checked against the nested JSON context of its own market."""
    b = _base(spark, sf)
    drafts = market_drafts(b).withColumn("context_id", F.col("draft_id"))
    return _verified(verify.verify_drafts(drafts, contexts.nested_facts(market_contexts(b))))


SCENARIO_DRAFT = ("%s: CLV moves by $%.2f per household (%.1f%%) to $%.2f, revenue by $%.3f per household per month and "
                  "lifetime by %.2f to %.1f months, worth $%.1fK in total; support cost falls by 7.77%%.")


def scenario_drafts(comparison: DataFrame) -> DataFrame:
    """A draft per scenario that quotes what it changes, and one figure that no fact backs."""
    delta = lambda k: F.col(f"scenario_{k}") - F.col(f"baseline_{k}")
    text = F.format_string(
        SCENARIO_DRAFT, F.col("scenario_id"), rint_round(delta("avg_clv"), 2), rint_round(F.col("clv_lift_pct") * 100.0, 1),
        rint_round("scenario_avg_clv", 2), rint_round(delta("avg_revenue_per_household"), 3),
        rint_round(delta("avg_expected_retained_months"), 2), rint_round("scenario_avg_expected_retained_months", 1),
        rint_round(F.col("incremental_value") / 1000.0, 1))
    return comparison.select(F.concat(F.lit("scenario:"), F.col("scenario_id")).alias("draft_id"),
                             F.col("scenario_id").alias("context_id"), text.alias("text"))


def q_scenario_verification(spark, sf):
    """N12 with N8-N15 - drafts that quote the presets' KPI changes, each checked against its scenario's context."""
    cmp = materialize(scenario.compare_scenarios(_base(spark, sf), scenario.PRESETS, RATE), "compared")
    facts = None
    for s in scenario.PRESETS:
        one = grounding.scenario_facts(cmp, s.scenario_id, s.levers, "All households", s.scenario_id)
        facts = one if facts is None else facts.unionByName(one)
    return _verified(verify.verify_drafts(scenario_drafts(cmp), facts))


def _documents(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def q_document_figures(spark, sf):
    """N8-N9 - every substantive figure in the whole documents table, parsed with its tolerance."""
    figs = verify.parse_figures(verify.extract_figures(_documents(spark, sf), ["doc_id"]))
    return finalize(figs.select("doc_id", "pos", "raw", "value", "tol"))


def q_document_verification(spark, sf):
    """N8-N15 - each document's figures traced against the overview grounding context."""
    b = _base(spark, sf)
    drafts = _documents(spark, sf).select(F.col("doc_id").cast("string").alias("draft_id"),
                                          F.lit("overview").alias("context_id"), "text")
    return _verified(verify.verify_drafts(drafts, overview_facts(b)))


def q_document_verification_stream(spark, sf):
    """N8-N15 through Structured Streaming: the documents land as JSON draft files in the shared folder and
    a micro-batch stream (availableNow, two files per trigger) verifies them against the overview context."""
    import uuid

    from cohortlens.session import table_path
    from cohortlens.streaming.drafts import verify_draft_stream
    b = _base(spark, sf)
    root = table_path(spark, f"draft_stream_{uuid.uuid4().hex}")
    drafts = _documents(spark, sf).select(F.col("doc_id").cast("string").alias("draft_id"),
                                          F.lit("overview").alias("context_id"), "text")
    drafts.write.json(f"{root}/in")
    q = verify_draft_stream(spark, f"{root}/in", overview_facts(b), f"{root}/out",
                            name=f"docs_{uuid.uuid4().hex[:8]}", max_files_per_trigger=2)
    q.awaitTermination()  # availableNow stops by itself when all files are done
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    out = spark.read.parquet(f"{root}/out").drop("batch_id")
    return _verified(out).select("draft_id", "context_id", "total", "verified", "unverified", "verdict")


RANKED_LINE_COLUMNS = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def _line_ranks(rows_per_bucket, broadcast_rows, row_id):
    def q(spark, sf):
        cols = RANKED_LINE_COLUMNS
        lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", *cols)
        lines = materialize(lines, "lines").withColumn("line_id", F.monotonically_increasing_id())  # its keys repeat
        ranked = with_percentile_ranks(lines, cols, [f"{c}_pr" for c in cols], row_id="line_id" if row_id else None,
                                       rows_per_bucket=rows_per_bucket, broadcast_rows=broadcast_rows)
        return ranked.select("l_orderkey", "l_linenumber", *[f"{c}_pr" for c in cols])
    return q


def _documented(q, text):
    q.__doc__ = text
    return q


QUERIES = {
    "line_ranks_broadcast": _documented(_line_ranks(None, None, False), "W1 on every line item; lookups in one broadcast."),
    "line_ranks_bucketed": _documented(_line_ranks(500, None, False), "W1 on every line item; values cut into ranges of about 500."),
    "line_ranks_shuffled": _documented(_line_ranks(500, 0, False), "W1 on every line item; value ranges, a shuffle join per column."),
    "line_ranks_long": _documented(_line_ranks(500, 0, True), "W1 on every line item; value ranges, one long-form join."),
    "cohort_table": q_cohort_table,
    "quality_issues": q_quality_issues,
    "quality_issues_injected": q_quality_issues_injected,
    "cleaned_injected": q_cleaned_injected,
    "issue_records_injected": q_issue_records_injected,
    "issue_records_empty": q_issue_records_empty,
    "dataset_created_once": q_dataset_created_once,
    "partitioned_results": q_partitioned_results,
    "cohort_csv_roundtrip": q_cohort_csv_roundtrip,
    "clv_detail": q_clv_detail,
    "survival_long": q_survival_long,
    "kpis": q_kpis,
    "kpis_by_market_device": q_kpis_by_market_device,
    "walkthrough": q_walkthrough,
    "revenue_mix": q_revenue_mix,
    "payback": q_payback,
    "payback_by_market_device": q_payback_by_market_device,
    "engagement_segments": q_engagement_segments,
    "kpis_other_terms": q_kpis_other_terms,
    "payback_other_terms": q_payback_other_terms,
    "unit_economics_grid": q_unit_economics_grid,
    "unit_economics_grid_by_market": q_unit_economics_grid_by_market,
    "clv_row_rates": q_clv_row_rates,
    "payback_row_rates": q_payback_row_rates,
    "exact_totals": q_exact_totals,
    "exact_weighted_means": q_exact_weighted_means,
    "dataset_rebuilt": q_dataset_rebuilt,
    "partitions_replaced": q_partitions_replaced,
    "cohort_csv_rejected": q_cohort_csv_rejected,
    "initiative_ranking_edited": q_initiative_ranking_edited,
    "nested_context_verification": q_nested_context_verification,
    "engagement_segments_weighted": q_engagement_segments_weighted,
    "household_scores": q_household_scores,
    "engagement_segments_ties": q_engagement_segments_ties,
    "segment_summary_segment": _summary("engagement_segment"),
    "segment_summary_market": _summary("market"),
    "segment_summary_device": _summary("device_type"),
    "segment_summary_month": _summary("cohort_month"),
    "segment_summary_region": _summary("region"),
    "segment_summaries": q_segment_summaries,
    "value_segments": q_value_segments,
    "monetization_scores": q_monetization_scores,
    "monetization_by_market": q_monetization_by_market,
    "monetization_by_device": q_monetization_by_device,
    "guardrail_segments": q_guardrail_segments,
    "monetization_kpis": q_monetization_kpis,
    "coverage": q_coverage,
    "cardinalities": q_cardinalities,
    "retention_curves": q_retention_curves,
    "headline_gaps": q_headline_gaps,
    "score_grid": q_score_grid,
    "score_points": q_score_points,
    "engagement_clv_grid": q_engagement_clv_grid,
    "depth_clv_grid": q_depth_clv_grid,
    "yield_by_market": q_yield_by_market,
    "yield_by_device": q_yield_by_device,
    "clv_by_cohort": q_clv_by_cohort,
    "filtered_kpis": q_filtered_kpis,
    "filtered_kpis_markets": q_filtered_kpis_markets,
    "walkthrough_scope": q_walkthrough_scope,
    "scoped_walkthrough": q_scoped_walkthrough,
    "scenario_presets": q_scenario_presets,
    "scenario_scoped": q_scenario_scoped,
    "scenario_verdicts": q_scenario_verdicts,
    "scenario_impact": q_scenario_impact,
    "scenario_levers": q_scenario_levers,
    "initiative_ranking": q_initiative_ranking,
    "initiative_ranking_uploaded": q_initiative_ranking_uploaded,
    "roadmap": q_roadmap,
    "impact_complexity": q_impact_complexity,
    "under_monetized": q_under_monetized,
    "vintage_trend": q_vintage_trend,
    "marginal_retention": q_marginal_retention,
    "marginal_retention_by_market": q_marginal_retention_by_market,
    "gap_insights": q_gap_insights,
    "grounding_facts": q_grounding_facts,
    "grounding_facts_planning": q_grounding_facts_planning,
    "draft_figures": q_draft_figures,
    "figure_verification": q_figure_verification,
    "scenario_verification": q_scenario_verification,
    "document_figures": q_document_figures,
    "document_verification": q_document_verification,
    "document_verification_stream": q_document_verification_stream,
}
