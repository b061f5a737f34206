"""Exact sums: no dependence on partitioning, no loss of small values, plain sums where no decimal holds a value."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.functions.numeric import exact_mean, exact_sum, weighted_mean


def _one(df, *cols):
    return df.agg(*cols).first()


def test_sums_do_not_depend_on_the_partitioning(spark):
    rows = [(0.1 * i + 1e-7 * (i % 7), 10**9 + i, 1e13 / 3 + i * 0.1) for i in range(4000)]
    df = spark.createDataFrame(rows, "x double, households long, total double")
    found = {
        tuple(_one(df.repartition(n, F.rand(n)), exact_sum("x", "households"), weighted_mean("x"), exact_sum("total"), exact_mean("total")))
        for n in (1, 2, 5, 9)
    }
    assert len(found) == 1
    total, _, plain, _ = found.pop()
    assert plain > 1e16
    assert math.isclose(plain, math.fsum(r[2] for r in rows), rel_tol=1e-15)
    assert math.isclose(total, math.fsum(r[0] * r[1] for r in rows), rel_tol=1e-14)


def test_small_values_and_ties_are_kept(spark):
    df = spark.createDataFrame([(3e-10, 1), (4e-10, 1)], "x double, households long")
    assert _one(df, weighted_mean("x"))[0] == 3.5e-10
    ties = spark.createDataFrame([(0.1, 3), (0.7, 1), (0.1, 4)], "x double, households long")
    assert _one(ties, exact_sum("x", "households"))[0] == 1.4


def test_fractional_weights_and_nulls(spark):
    df = spark.createDataFrame([(2.0, 1.5), (4.0, 0.5), (None, 7.0), (3.0, None)], "x double, households double")
    assert _one(df, exact_sum("x", "households"))[0] == 5.0
    assert _one(df.where("x is null"), exact_sum("x", "households"), exact_sum("x"), exact_mean("x")) == (None, None, None)
    assert _one(df.limit(0), exact_sum("x"), weighted_mean("x")) == (None, None)


def test_values_beyond_decimals_give_the_plain_sum(spark):
    df = spark.createDataFrame([(1e25, 2), (1.0, 1)], "x double, households long")
    assert _one(df, exact_sum("x", "households"), exact_sum("x")) == (2e25 + 1, 1e25 + 1)
    bad = spark.createDataFrame([(float("nan"), 1), (1.0, 1)], "x double, households long")
    assert math.isnan(_one(bad, exact_sum("x", "households"))[0])
    huge = spark.createDataFrame([(9e19,)] * 3, "x double")
    assert _one(huge, exact_sum("x"))[0] == 2.7e20


def test_over_a_window(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.7)], "k string, x double")
    got = {(r.k, r.s) for r in df.select("k", exact_sum("x", over=Window.partitionBy("k")).alias("s")).collect()}
    assert got == {("a", 0.3), ("b", 0.7)}
