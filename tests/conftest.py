import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from cohortlens.session import DEFAULT_CONF, ensure_checkpoint_dir

    b = SparkSession.builder.master("local[4]").appName("cohortlens-tests").config("spark.sql.shuffle.partitions", "4")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext._jsc.sc().getCheckpointDir().isDefined() and not s.sparkContext.getConf().get(
            "spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-test-ckpt-"))
    ensure_checkpoint_dir(s)
    yield s


GOLDEN = dict(
    cohort_month="2025-03", market="Mexico", region="Latin America", device_type="Streaming Stick",
    households=1000, activation_rate=0.86, first_week_hours=20.0, first_week_app_installs=5.5,
    trc_usage_rate=0.42, subscription_conversion_rate=0.28, monthly_streaming_hours=140.0,
    ad_supported_share=0.62, ad_impressions_per_hour=21.0, cpm=32.0, fill_rate=0.80, subscription_arpu=9.99,
    gross_margin=0.55, month_1_retention=0.72, month_3_retention=0.67, month_6_retention=0.60,
    month_12_retention=0.48, support_cost_per_household=0.55,
)


def cohort_df(spark, rows):
    from cohortlens.schema import COHORT_SCHEMA, REQUIRED_COLUMNS

    return spark.createDataFrame([tuple(r[c] for c in REQUIRED_COLUMNS) for r in rows], COHORT_SCHEMA)


def golden_rows(n=1, **over):
    out = []
    for i in range(n):
        r = dict(GOLDEN)
        r.update(over)
        out.append(r)
    return out
