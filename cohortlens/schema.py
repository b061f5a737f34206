"""Cohort table schema and the model's fixed constants.

Fixed values: the column names, rate/non-negative column lists, model horizon,
revenue-share constants, elasticities and defaults below must equal the cohort
model's published definitions for results to match. They are stated here
plainly, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: required cohort columns, in required order -------------
KEY_COLUMNS = ["cohort_month", "market", "region", "device_type"]
REQUIRED_COLUMNS = [
    "cohort_month",
    "market",
    "region",
    "device_type",
    "households",
    "activation_rate",
    "first_week_hours",
    "first_week_app_installs",
    "trc_usage_rate",
    "subscription_conversion_rate",
    "monthly_streaming_hours",
    "ad_supported_share",
    "ad_impressions_per_hour",
    "cpm",
    "fill_rate",
    "subscription_arpu",
    "gross_margin",
    "month_1_retention",
    "month_3_retention",
    "month_6_retention",
    "month_12_retention",
    "support_cost_per_household",
]

# ---- fixed values: columns that must lie in [0, 1] --------------------------
RATE_COLUMNS = [
    "activation_rate",
    "trc_usage_rate",
    "subscription_conversion_rate",
    "ad_supported_share",
    "fill_rate",
    "gross_margin",
    "month_1_retention",
    "month_3_retention",
    "month_6_retention",
    "month_12_retention",
]

# ---- fixed values: non-negative drivers (clipped at 0), in check order ------
NON_NEGATIVE_COLUMNS = [
    "households",
    "monthly_streaming_hours",
    "cpm",
    "subscription_arpu",
    "support_cost_per_household",
    "ad_impressions_per_hour",
]

RETENTION_COLUMNS = [
    "month_1_retention",
    "month_3_retention",
    "month_6_retention",
    "month_12_retention",
]
RETENTION_MONTHS = [1, 3, 6, 12]

# ---- fixed values: model constants ------------------------------------------
CLV_HORIZON_MONTHS = 24
AD_MONETIZATION_SHARE = 0.10
SUBSCRIPTION_REVENUE_SHARE = 0.20
SURVIVAL_FLOOR = 1e-4
DECAY_MIN, DECAY_MAX = 0.5, 1.0
DEFAULT_DISCOUNT_RATE = 0.10
DEFAULT_ACQUISITION_COST = 8.0

# ---- fixed values: scenario elasticities ------------------------------------
FIRST_WEEK_TO_RETENTION = 0.25
APP_INSTALL_TO_RETENTION = 0.15
TRC_TO_RETENTION = 0.20
TRC_TO_HOURS = 0.40
RISK_TO_HOURS = 0.50
SCENARIO_RETENTION_CAP = 0.98
SCENARIO_MARGIN_CAP = 0.95

# ---- fixed values: scenario levers, in order --------------------------------
SCENARIO_LEVERS = [
    "first_week_lift",
    "app_install_lift",
    "trc_usage_lift",
    "sub_conversion_lift",
    "retention_lift",
    "cpm_lift",
    "gross_margin_change",
    "experience_risk_penalty",
]

# ---- fixed values: engagement score components and default weights ----------
ENGAGEMENT_COMPONENTS = [
    "first_week_hours",
    "first_week_app_installs",
    "trc_usage_rate",
    "monthly_streaming_hours",
]
DEFAULT_ENGAGEMENT_WEIGHTS = (1.0, 1.0, 1.0, 1.0)
SEGMENT_LABELS = ("Low", "Medium", "High")

# Segment key separator: middle dot (U+00B7) between spaces.
SEGMENT_SEPARATOR = " · "

_STRING = {"cohort_month", "market", "region", "device_type"}

COHORT_SCHEMA = T.StructType(
    [
        T.StructField(
            c,
            T.StringType() if c in _STRING else (T.LongType() if c == "households" else T.DoubleType()),
            True,
        )
        for c in REQUIRED_COLUMNS
    ]
)
