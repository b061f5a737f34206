"""The baseline table: load -> validate -> CLV -> ranks -> scores -> segments.

Order matters: ranks and terciles are global over the validated table and are
computed before any filter is applied by downstream views.

Materialisation: the input cohort table and the final baseline are parquet
tables in the shared ``spark.checkpoint.dir`` folder.
That cuts the lineage back to the fact tables (a lost executor re-reads files
instead of recomputing the facts) and lets every downstream view read the
baseline - only the columns it needs, with filters pushed into the scan -
without re-running the rank jobs. A small in-process registry reuses
the materialised baseline for repeated requests with the same inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.monetization import add_ratio_metrics, balanced_column, score_columns
from cohortlens.operators.quality import Validation, validate
from cohortlens.operators.ranks import with_percentile_ranks
from cohortlens.operators.segments import assign_terciles, engagement_score_expr, tercile_edges
from cohortlens.operators.value import run_clv_model
from cohortlens.schema import DEFAULT_DISCOUNT_RATE, ENGAGEMENT_COMPONENTS
from cohortlens.session import materialize
from cohortlens.sources.facts import cohorts_from_facts

# the 13 distinct ranked columns (engagement 4; depth 5; health 6; CLV), each ranked once
RANKED_COLUMNS = [
    "first_week_hours",
    "first_week_app_installs",
    "trc_usage_rate",
    "monthly_streaming_hours",
    "revenue_per_household",
    "monetization_per_streaming_hour",
    "subscription_conversion_rate",
    "ad_supported_share",
    "fill_rate",
    "month_6_retention",
    "month_12_retention",
    "month_1_retention",
    "discounted_clv",
]


ROW_ID = "__rid"


def _pr(c: str) -> str:
    return f"__pr_{c}"


@dataclass
class Baseline:
    table: DataFrame
    validation: Validation
    discount_rate: float


def add_scores(clv: DataFrame, weights=None, held: list | None = None, max_rows: int | None = None,
               row_id: str | None = None, **rank_sizes) -> DataFrame:
    """Append W1 ranks (internal), W2 engagement score, W5-W7 scores, W3/W4 segment.

    The scored table is persisted before the tercile edges are read from it,
    so the rank join-back runs once for the edges and the final write.
    ``rank_sizes`` (``rows_per_bucket``, ``broadcast_rows``) go to the ranks.
    """
    held = held if held is not None else []
    mon = add_ratio_metrics(clv)
    ranked = with_percentile_ranks(mon, RANKED_COLUMNS, [_pr(c) for c in RANKED_COLUMNS], max_rows, row_id,
                                   **rank_sizes)
    scored = ranked.withColumn("engagement_score",
                               engagement_score_expr(weights, [_pr(c) for c in ENGAGEMENT_COMPONENTS]))
    scored = scored.withColumns(score_columns(_pr))
    scored = scored.withColumn("balanced_value_score", balanced_column(_pr))
    scored = scored.drop(*[_pr(c) for c in RANKED_COLUMNS]).persist(StorageLevel.MEMORY_AND_DISK)
    held.append(scored)
    edges = tercile_edges(scored)
    return assign_terciles(scored, edges, max_rows=max_rows)


BASELINE_ORDER_TAIL = [
    "engagement_score", "engagement_segment",
    "ad_revenue_per_household", "subscription_revenue_per_household", "total_monthly_revenue_per_household",
    "gross_profit_per_household", "expected_retained_months", "baseline_clv", "discounted_clv",
    "total_lifecycle_value", "revenue_per_household", "monetization_per_streaming_hour", "ad_revenue_share",
    "subscription_revenue_share", "monetization_depth_score", "experience_health_score", "balanced_value_score",
]


def build_baseline(cohorts: DataFrame, annual_discount_rate: float = DEFAULT_DISCOUNT_RATE,
                   weights=None, **rank_sizes) -> Baseline:
    """Validate, model and score a cohort table; raises ``ValueError`` on blocking errors."""
    # the (expensive) source plan runs once; row ids over the written files are stable on recompute
    raw = materialize(cohorts, "cohorts").withColumn(ROW_ID, F.monotonically_increasing_id())
    v = validate(raw)
    if v.errors:
        raise ValueError("; ".join(v.errors))
    clv = run_clv_model(v.clean, annual_discount_rate)
    held: list = []
    scored = add_scores(clv, weights, held, max_rows=v.rows_out, row_id=ROW_ID, **rank_sizes)
    cols = [c for c in cohorts.columns if c not in BASELINE_ORDER_TAIL] + BASELINE_ORDER_TAIL
    table = materialize(scored.select(*cols), "baseline")
    for frame in held:
        frame.unpersist()
    return Baseline(table, v, annual_discount_rate)


_REGISTRY: dict[tuple, Baseline] = {}


def fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """Files of the fact tables with size and time, from the file system that Spark reads them by."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    out = []
    for n in ("lineitem", "orders", "customer", "nation", "region"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{n}.parquet")
        for f in path.getFileSystem(conf).listStatus(path):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def baseline_for(spark: SparkSession, sf_dir: str, annual_discount_rate: float = DEFAULT_DISCOUNT_RATE,
                 weights=None) -> Baseline:
    """Baseline built from the fact tables in ``sf_dir`` (memoised per session and inputs)."""
    key = (id(spark._jsparkSession), fingerprint(spark, sf_dir), float(annual_discount_rate),
           tuple(weights) if weights is not None else None)
    b = _REGISTRY.get(key)
    if b is None:
        b = build_baseline(cohorts_from_facts(spark, sf_dir), annual_discount_rate, weights)
        _REGISTRY[key] = b
    return b


def build_baseline_cached(key: tuple, cohorts: DataFrame, annual_discount_rate: float = DEFAULT_DISCOUNT_RATE,
                          weights=None) -> DataFrame:
    """Baseline of an arbitrary cohort table, memoised under a caller-chosen key."""
    full = (id(cohorts.sparkSession._jsparkSession), "custom", key, float(annual_discount_rate),
            tuple(weights) if weights is not None else None)
    b = _REGISTRY.get(full)
    if b is None:
        b = build_baseline(cohorts, annual_discount_rate, weights)
        _REGISTRY[full] = b
    return b.table


def baseline_table(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return baseline_for(spark, sf_dir, **kw).table


def scored_columns() -> list[str]:
    return list(BASELINE_ORDER_TAIL)


__all__ = ["Baseline", "build_baseline", "baseline_for", "baseline_table", "add_scores", "RANKED_COLUMNS", "F"]
