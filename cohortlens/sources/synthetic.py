"""S3 - synthetic cohort table, generated as a distributed job.

12 cohort months x 6 markets x 4 device types per replica (288 rows per
replica). A latent quality factor drives first-week engagement, free-channel
usage, hours, retention and conversion together. Random draws are hashed
uniforms ``xxhash64(seed, row id, draw)`` (reproducible on any partitioning
and on recompute) with Box-Muller normals; only the distributions are
reproduced, not any particular generator's sample stream.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.numeric import rint_round
from cohortlens.schema import REQUIRED_COLUMNS

# ---- fixed values: market profiles (cpm, arpu, sub_conv, ret, hh, cost, region) ----
MARKET_PROFILES = [
    ("United States", 32.0, 9.99, 0.28, 0.78, 42000, 0.55, "North America"),
    ("Canada", 24.0, 8.99, 0.24, 0.76, 9000, 0.50, "North America"),
    ("Mexico", 9.0, 4.99, 0.14, 0.70, 14000, 0.25, "Latin America"),
    ("Brazil", 7.5, 4.49, 0.13, 0.68, 16000, 0.22, "Latin America"),
    ("United Kingdom", 21.0, 8.49, 0.22, 0.75, 11000, 0.48, "Europe"),
    ("Germany", 18.0, 7.99, 0.19, 0.73, 8000, 0.45, "Europe"),
]
# ---- fixed values: device profiles (engagement multiplier, household share) ----
DEVICE_PROFILES = [
    ("Smart TV OS", 1.12, 0.40),
    ("Streaming Stick", 1.00, 0.30),
    ("Streaming Box", 1.06, 0.15),
    ("Partner TV", 0.88, 0.15),
]
N_MONTHS = 12
START_YEAR = 2025
HOLIDAY_SIZE_MONTHS = (1, 11, 12)
HOLIDAY_QUALITY_MONTHS = (1, 12)


def _uniform(seed: int, k: int) -> Column:
    h = F.xxhash64(F.lit(seed), F.col("id"), F.lit(k))
    return (F.abs(h % F.lit(1 << 40)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 40))


def _normal(seed: int, k: int) -> Column:
    u1, u2 = _uniform(seed, k), _uniform(seed, k + 1000)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def _between(u: Column, lo: float, hi: float) -> Column:
    return F.lit(lo) + (F.lit(hi) - F.lit(lo)) * u


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def generate_cohorts(spark: SparkSession, replicas: int = 1, seed: int = 42,
                     num_partitions: int | None = None) -> DataFrame:
    """A cohort table of ``288 * replicas`` rows.

    Replica r adds ``r`` years to the cohort months; after the year 9999 they
    start again, so months sort as text and keys repeat with other values.
    """
    nm, nd = len(MARKET_PROFILES), len(DEVICE_PROFILES)
    n = N_MONTHS * nm * nd * replicas
    base = spark.range(0, n, 1, num_partitions) if num_partitions else spark.range(n)
    pick = lambda idx, vals: F.element_at(F.array(*[F.lit(v) for v in vals]), idx + 1)
    cell = F.col("id") % F.lit(N_MONTHS * nm * nd)
    rep = (F.col("id") / F.lit(N_MONTHS * nm * nd)).cast("long")
    month_i = (cell / F.lit(nm * nd)).cast("int")
    market_i = ((cell / F.lit(nd)).cast("int") % nm)
    device_i = (cell % nd).cast("int")
    df = base.select(
        "id", month_i.alias("mi"), market_i.alias("ki"), device_i.alias("di"), rep.alias("rep"))
    mp = list(zip(*MARKET_PROFILES))
    dp = list(zip(*DEVICE_PROFILES))
    df = df.select(
        "*",
        pick(F.col("ki"), mp[0]).alias("market"), pick(F.col("ki"), mp[7]).alias("region"),
        pick(F.col("di"), dp[0]).alias("device_type"),
        pick(F.col("ki"), mp[1]).alias("p_cpm"), pick(F.col("ki"), mp[2]).alias("p_arpu"),
        pick(F.col("ki"), mp[3]).alias("p_conv"), pick(F.col("ki"), mp[4]).alias("p_ret"),
        pick(F.col("ki"), [float(x) for x in mp[5]]).alias("p_hh"), pick(F.col("ki"), mp[6]).alias("p_cost"),
        pick(F.col("di"), dp[1]).alias("d_eng"), pick(F.col("di"), dp[2]).alias("d_share"),
    )
    month_num = F.col("mi") + 1
    seasonal_size = F.when(month_num.isin(*HOLIDAY_SIZE_MONTHS), 1.25).otherwise(1.0)
    seasonal_quality = F.when(month_num.isin(*HOLIDAY_QUALITY_MONTHS), 0.96).otherwise(1.0)
    q = _clip(F.lit(1.0) + F.lit(0.10) * _normal(seed, 1), 0.75, 1.30) * F.col("d_eng") * seasonal_quality
    df = df.withColumn("q", q)
    u = lambda k, lo, hi: _between(_uniform(seed, k), lo, hi)
    m1 = _clip(F.col("p_ret") * (F.lit(0.92) + F.lit(0.10) * (F.col("q") - 1.0) * 2.5) * u(4, 0.98, 1.02), 0.40, 0.95)
    decay = _clip(F.lit(0.965) + F.lit(0.02) * (F.col("q") - 1.0), 0.93, 0.985)
    df = df.withColumns({"m1": m1, "decay": decay})
    year = F.lit(START_YEAR) + F.col("rep") % F.lit(10_000 - START_YEAR)
    out = df.select(
        F.concat(year.cast("string"), F.lit("-"), F.lpad(month_num.cast("string"), 2, "0")).alias("cohort_month"),
        "market", "region", "device_type",
        F.floor(F.col("p_hh") * F.col("d_share") * seasonal_size * u(2, 0.9, 1.1)).cast("bigint").alias("households"),
        rint_round(_clip(F.lit(0.86) * F.col("q") * u(9, 0.95, 1.05), 0.55, 0.98), 3).alias("activation_rate"),
        rint_round(_clip(F.lit(20.0) * F.col("q") * u(5, 0.9, 1.1), 4, 45), 1).alias("first_week_hours"),
        rint_round(_clip(F.lit(5.5) * F.col("q") * u(6, 0.85, 1.15), 1, 14), 1).alias("first_week_app_installs"),
        rint_round(_clip(F.lit(0.42) * F.col("q") * u(7, 0.9, 1.1), 0.05, 0.85), 3).alias("trc_usage_rate"),
        rint_round(_clip(F.col("p_conv") * (F.lit(0.85) + F.lit(0.30) * (F.col("q") - 0.9)) * u(8, 0.92, 1.08),
                         0.02, 0.45), 3).alias("subscription_conversion_rate"),
        rint_round(_clip(F.lit(140.0) * F.col("q") * u(3, 0.9, 1.1), 40, 280), 1).alias("monthly_streaming_hours"),
        rint_round(_clip(F.lit(0.62) + F.lit(0.05) * _normal(seed, 10), 0.40, 0.80), 3).alias("ad_supported_share"),
        rint_round(u(11, 16, 26), 1).alias("ad_impressions_per_hour"),
        rint_round(F.col("p_cpm") * u(12, 0.9, 1.1), 2).alias("cpm"),
        rint_round(_clip(F.lit(0.80) + F.lit(0.05) * _normal(seed, 13), 0.55, 0.95), 3).alias("fill_rate"),
        rint_round(F.col("p_arpu") * u(14, 0.95, 1.05), 2).alias("subscription_arpu"),
        rint_round(_clip(F.lit(0.55) + F.lit(0.04) * _normal(seed, 15), 0.40, 0.68), 3).alias("gross_margin"),
        rint_round(F.col("m1"), 3).alias("month_1_retention"),
        rint_round(F.col("m1") * F.pow(F.col("decay"), 2), 3).alias("month_3_retention"),
        rint_round(F.col("m1") * F.pow(F.col("decay"), 5), 3).alias("month_6_retention"),
        rint_round(F.col("m1") * F.pow(F.col("decay"), 11), 3).alias("month_12_retention"),
        rint_round(F.col("p_cost") * u(16, 0.9, 1.1), 2).alias("support_cost_per_household"),
    )
    return out.select(*REQUIRED_COLUMNS)
