"""I1-I12 initiative prioritisation.

Initiatives are planning parameters. Their driver lifts run through the
scenario engine against the WHOLE baseline as a table (one fan-out in blocks,
one ``groupBy``; nothing is collected and any number is scored); everything
after that - min-max normalisation, composite scores, rank, classification,
roadmap - works on the initiative-sized result, where global windows are fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.numeric import rint_round
from cohortlens.operators.ranks import minmax_normalized, ordinal_rank
from cohortlens.operators.scenario import SCENARIO_STRUCT, compare_scenario_table
from cohortlens.schema import DEFAULT_DISCOUNT_RATE, SCENARIO_LEVERS
from cohortlens.session import materialize

# ---- fixed values: initiative levers and qualitative fields, in order -------
LIFT_FIELDS = ["first_week_lift", "app_install_lift", "trc_usage_lift", "sub_conversion_lift", "retention_lift",
               "cpm_lift"]
QUAL_FIELDS = ["confidence", "speed", "complexity", "strategic_fit", "risk", "retention_risk"]
INPUT_COLUMNS = ["initiative"] + LIFT_FIELDS + ["cost"] + QUAL_FIELDS + ["thesis"]
DEFAULT_QUAL = 3.0

INITIATIVE_SCHEMA = T.StructType(
    [T.StructField("initiative", T.StringType())]
    + [T.StructField(f, T.DoubleType()) for f in LIFT_FIELDS]
    + [T.StructField("cost", T.DoubleType())]
    + [T.StructField(f, T.DoubleType()) for f in QUAL_FIELDS]
    + [T.StructField("thesis", T.StringType())]
)

# ---- fixed values: the preset initiative portfolio --------------------------
# (initiative, fw, ai, trc, sub, ret, cpm, cost, confidence, speed, complexity, fit, risk, retention_risk, thesis)
PRESET_INITIATIVES = [
    ("Onboarding Optimization", 0.15, 0.10, 0.0, 0.0, 0.0, 0.0, 750_000.0, 4.0, 4.0, 2.0, 5.0, 2.0, 1.0,
     "Improve first-week setup and content discovery: strong experience and retention lift, indirect "
     "monetization lift."),
    ("Home Screen Discovery Personalization", 0.08, 0.0, 0.10, 0.0, 0.02, 0.0, 1_500_000.0, 3.0, 3.0, 4.0, 5.0, 3.0,
     2.0, "Personalized rows and recommendations: strong experience impact, medium/high monetization lift through "
     "engagement, low retention risk."),
    ("Roku Channel-Style Engagement Push", 0.0, 0.0, 0.20, 0.0, 0.0, 0.0, 900_000.0, 4.0, 4.0, 2.0, 4.0, 2.0, 2.0,
     "Drive owned free-channel viewing: medium/high monetization lift (high-margin ad inventory) with positive "
     "engagement impact."),
    ("Subscription Merchandising", 0.0, 0.0, 0.0, 0.18, 0.0, 0.0, 600_000.0, 4.0, 5.0, 2.0, 4.0, 2.0, 3.0,
     "Better placement, bundling, and offers: high monetization lift, medium experience risk if merchandising "
     "gets too aggressive."),
    ("Ad Monetization Optimization", 0.0, 0.0, 0.0, 0.0, 0.0, 0.12, 800_000.0, 4.0, 4.0, 3.0, 4.0, 3.0, 4.0,
     "Better yield management, fill, and pricing: high monetization lift, but possible experience risk if it "
     "drifts into ad load."),
    ("Win-back / Reactivation Campaign", 0.0, 0.0, 0.0, 0.0, 0.05, 0.0, 1_100_000.0, 3.0, 3.0, 3.0, 3.0, 3.0, 2.0,
     "Targeted campaigns to recover lapsing households: medium monetization lift, medium confidence."),
    ("International Lifecycle Optimization", 0.10, 0.0, 0.0, 0.0, 0.03, 0.08, 2_000_000.0, 2.0, 2.0, 4.0, 4.0, 4.0,
     3.0, "Localize onboarding and monetization in international markets where retention and CPMs lag the US."),
    ("Reporting Infrastructure / BI Automation", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 500_000.0, 5.0, 3.0, 3.0, 4.0, 1.0,
     1.0, "Automate cohort/CLV reporting: an enabler — no direct revenue, but improves planning quality and "
     "decision speed."),
]

# ---- fixed values: composite score weights ----------------------------------
LEGACY_WEIGHTS = {"n_incremental_value": 0.30, "n_clv_lift_pct": 0.15, "n_roi": 0.15, "confidence": 0.10,
                  "speed": 0.10, "strategic_fit": 0.10, "complexity": -0.10, "risk": -0.10}
BALANCED_WEIGHTS = {"n_monetization_lift": 0.25, "n_incremental_value": 0.20, "n_experience_impact": 0.15,
                    "confidence": 0.10, "strategic_fit": 0.10, "speed": 0.05, "complexity": -0.10,
                    "retention_risk": -0.15}
ENABLER_THRESHOLD = 0.005
QUICK_WIN_COMPLEXITY = 2.5
ROADMAP_BUCKETS = {"Quick win": "Now", "Strategic bet": "Next", "Enabler": "Foundational"}


def initiatives_table(spark: SparkSession) -> DataFrame:
    """S4 - the preset portfolio as a table of input assumptions."""
    return spark.createDataFrame(PRESET_INITIATIVES, INITIATIVE_SCHEMA)


def edit_initiatives(table: DataFrame, changes: DataFrame) -> DataFrame:
    """S5 - ``table`` after a keyed change set: rows added, changed or removed by the name of the initiative.

    ``changes`` has ``initiative``, any of the other columns and, where rows go, a boolean ``removed``. A cell that is null or absent
    leaves the value as it is; a name that the table lacks is a new row. Names are compared without outer spaces; rows
    of ``changes`` without a name change nothing, and of several for one name the one with the largest values counts. One full outer
    join of two tables of any length; names may repeat in ``table``, then each of their rows changes.
    """
    fields = [f for f in INITIATIVE_SCHEMA.fields if f.name != "initiative"]
    key = F.trim("initiative")
    given = {f.name: F.col(f.name).cast(f.dataType) if f.name in changes.columns else F.lit(None).cast(f.dataType) for f in fields}
    removed = F.coalesce(F.col("removed"), F.lit(False)) if "removed" in changes.columns else F.lit(False)
    told = changes.where(F.coalesce(key, F.lit("")) != "").groupBy(key.alias("__key")).agg(
        F.max(F.struct(removed.alias("__removed"), *[c.alias(f"__new_{n}") for n, c in given.items()])).alias("c")).select("__key", "c.*")
    both = table.join(told, key == F.col("__key"), "full_outer").where(~F.coalesce(F.col("__removed"), F.lit(False)))
    return both.select(F.coalesce("initiative", "__key").alias("initiative"),
                       *[F.coalesce(F.col(f"__new_{f.name}"), F.col(f.name).cast(f.dataType)).alias(f.name) for f in fields])


def _num(c: str, default: float) -> F.Column:
    x = F.col(c).try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(x)


def clean_initiatives(df: DataFrame) -> DataFrame:
    """I1 / S5 - add missing columns, trim names, skip blank names, default blank numbers.

    Blank lifts and cost become 0, blank qualitative scores 3, blank thesis "".
    ``position`` keeps the input order (it identifies rows even if names repeat).
    """
    for f in INITIATIVE_SCHEMA.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    name = F.trim(F.coalesce(F.col("initiative").cast("string"), F.lit("")))
    out = df.select(
        F.monotonically_increasing_id().alias("_order"),
        name.alias("initiative"),
        *[_num(c, 0.0).alias(c) for c in LIFT_FIELDS],
        _num("cost", 0.0).alias("cost"),
        *[_num(c, DEFAULT_QUAL).alias(c) for c in QUAL_FIELDS],
        F.coalesce(F.col("thesis").cast("string"), F.lit("")).alias("thesis"),
    ).where(F.col("initiative") != "")
    return out


def _as_scenarios(clean: DataFrame) -> DataFrame:
    """Each initiative's lifts and cost as a scenario over all rows, named by its id."""
    zero = F.lit(0.0)
    fields = {f.name: F.lit(None).cast(f.dataType) for f in SCENARIO_STRUCT.fields}
    fields |= {n: F.col(n) if n in LIFT_FIELDS else zero for n in SCENARIO_LEVERS}
    fields |= {"scenario_id": F.col("scenario_id"), "cost": F.when(F.col("cost") > 0, F.col("cost"))}
    return clean.select(*[c.alias(n) for n, c in fields.items()])


def _weighted(weights: dict) -> F.Column:
    out = None
    for c, w in weights.items():
        x = F.col(c) if c.startswith("n_") else F.col(c) / F.lit(5.0)
        term = F.lit(abs(w)) * x
        out = term if out is None else (out + term if w > 0 else out - term)
    return out


def score_initiatives(baseline: DataFrame, initiatives: DataFrame | None = None,
                      annual_discount_rate: float = DEFAULT_DISCOUNT_RATE) -> DataFrame:
    """I2-I9 - modeled financials through the scenario engine, scores, rank and class."""
    spark = baseline.sparkSession
    clean = clean_initiatives(initiatives if initiatives is not None else initiatives_table(spark))
    clean = materialize(clean, "initiatives").withColumn("scenario_id", F.col("_order").cast("string"))
    p = clean.select("scenario_id", F.col("_order").alias("position"), "initiative", "thesis", "cost", *QUAL_FIELDS)
    cmp = compare_scenario_table(baseline, _as_scenarios(clean), annual_discount_rate)

    def rel(scen_col, base_col):
        return F.when(F.col(base_col) != 0, F.col(scen_col) / F.col(base_col) - F.lit(1.0)).otherwise(F.lit(0.0))

    t = cmp.select(
        "scenario_id", "incremental_value", "clv_lift_pct",
        rel("scenario_avg_revenue_per_household", "baseline_avg_revenue_per_household").alias("monetization_lift"),
        (F.lit(0.5) * rel("scenario_avg_month_6_retention", "baseline_avg_month_6_retention")
         + F.lit(0.3) * rel("scenario_hours", "baseline_hours")
         + F.lit(0.2) * rel("scenario_first_week_hours", "baseline_first_week_hours")).alias("experience_impact"),
        F.coalesce(F.col("roi"), F.lit(0.0)).alias("roi"),
        "payback_months", "never_pays_back",
    ).join(p, "scenario_id")  # both sides are one row per initiative
    t = materialize(t, "initiative_results")  # read for the extremes and again to rate against them
    t = minmax_normalized(t, {c: f"n_{c}" for c in ("incremental_value", "clv_lift_pct", "roi", "monetization_lift", "experience_impact")})
    t = t.withColumn("_score", _weighted(LEGACY_WEIGHTS)).withColumn("_bal", _weighted(BALANCED_WEIGHTS))
    t = minmax_normalized(t, {"_score": "_ns", "_bal": "_nb"})
    t = t.withColumns({"score": rint_round(F.lit(100.0) * F.col("_ns"), 1),
                       "balanced_score": rint_round(F.lit(100.0) * F.col("_nb"), 1)})
    t = ordinal_rank(t, [F.desc("balanced_score"), F.asc("initiative"), F.asc("position")], "rank").withColumn("rank", F.col("rank").cast("int"))
    cls = (F.when((F.col("monetization_lift") < ENABLER_THRESHOLD) & (F.col("experience_impact") < ENABLER_THRESHOLD),
                  "Enabler")
           .when(F.col("complexity") <= QUICK_WIN_COMPLEXITY, "Quick win").otherwise("Strategic bet"))
    t = t.withColumn("classification", cls)
    return t.select("rank", "initiative", "classification", "balanced_score", "score", "monetization_lift",
                    "experience_impact", "incremental_value", "clv_lift_pct", "roi", "payback_months",
                    "never_pays_back", "cost", *QUAL_FIELDS, "thesis")


def roadmap(ranked: DataFrame) -> DataFrame:
    """I10 - Now / Next / Foundational buckets in rank order; value and ROI shown unless ROI is 0."""
    bucket = F.create_map(*[x for k, v in ROADMAP_BUCKETS.items() for x in (F.lit(k), F.lit(v))])
    placed = ordinal_rank(ranked, [F.asc("classification"), F.asc("rank")], "__at")
    first = placed.groupBy("classification").agg(F.min("__at").alias("__first"))  # one row per class
    ranked = placed.join(first, "classification")
    show = F.col("roi") != 0
    return ranked.select(
        bucket[F.col("classification")].alias("bucket"), "classification",
        (F.col("__at") - F.col("__first") + 1).cast("int").alias("bucket_position"), "rank", "initiative",
        F.when(show, F.col("incremental_value")).alias("incremental_value"),
        F.when(show, F.col("roi")).alias("roi"))


def impact_complexity(ranked: DataFrame) -> DataFrame:
    """I11 - points for the impact vs complexity matrix (size = max(score, 5)); I12 flag on the top rank."""
    return ranked.select("initiative", "classification", "complexity", "incremental_value",
                         F.greatest(F.col("score"), F.lit(5.0)).alias("size"), (F.col("rank") == 1).alias("is_top"))


def top_initiative(ranked: DataFrame) -> DataFrame:
    """I12 - the first-ranked initiative."""
    return ranked.agg(F.min_by("initiative", "rank").alias("top_initiative"))
