"""Totals that are exact for every double: against whole fractions of the printed decimals."""

import math
import random
import re
import struct
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from cohortlens.operators.totals import exact_totals, exact_weighted_means


def rounded(total):
    try:
        return total.numerator / total.denominator
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def plain(values):
    return rounded(sum((Fraction(Decimal(repr(v))) for v in values), Fraction(0)))


def total(spark, values):
    return exact_totals(spark.createDataFrame([(v,) for v in values], "x double"), {"total": "x"}).first().total


def test_no_size_is_a_switch(spark):
    """Values from 1e-300 to 1e300 whose large parts cancel, over several partitionings."""
    rng = random.Random(3)
    large = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(15, 300) for _ in range(300)]
    small = [rng.uniform(-1, 1) * 10.0 ** -rng.randrange(10, 300) for _ in range(300)]
    values = large + [-x for x in large] + small
    rng.shuffle(values)
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    found = {exact_totals(frame.repartition(n, F.rand(n)), {"total": "x"}).first().total for n in (1, 3, 8)}
    assert found == {plain(small)}
    assert total(spark, [1e20, 1.0, -1e20]) == 1.0
    assert total(spark, [0.1, 0.2]) == 0.3
    assert total(spark, [5e-324, 5e-324, -0.0]) == 1e-323
    assert total(spark, [1.7976931348623157e308] * 2) == math.inf
    assert total(spark, [1.7976931348623157e308] * 2 + [-1.7976931348623157e308]) == 1.7976931348623157e308


def test_any_doubles(spark):
    """Random bit patterns, a group for each list; what Spark prints for a value is what counts."""
    rng = random.Random(5)
    doubles = [x for (x,) in struct.iter_unpack("<d", rng.randbytes(8 * 1500)) if math.isfinite(x)]
    near = [rng.choice((1, -1)) * rng.uniform(1, 10) * 10.0 ** rng.randrange(-3, 20) for _ in range(1500)]
    frame = spark.createDataFrame([(rng.randrange(150) + 1000 * (v in near), v) for v in doubles + near], "k long, x double")
    printed = {}
    for r in frame.select("k", F.col("x").cast("string").alias("x")).collect():
        printed.setdefault(r.k, []).append(Fraction(Decimal(r.x)))
    assert {r.k: r.total for r in exact_totals(frame, {"total": "x"}, ["k"]).collect()} == {k: rounded(sum(v)) for k, v in printed.items()}


def test_products_and_means(spark):
    frame = spark.createDataFrame([(1.2346e-13, 3), (2.3457e-13, 4)], "x double, households long")
    assert exact_weighted_means(frame, ["x"]).first().x == float(Decimal("10.7410E-13") + Decimal("2.3456E-13")) / 7.0
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.uniform(-1, 1) * 10.0 ** rng.randrange(-40, 40), rng.uniform(0, 9), rng.randrange(-(2**63), 2**63)) for _ in range(200)]
    frame = spark.createDataFrame(rows, "k string, x double, f double, n long")
    got = {r.k: (r.xf, r.xn, r.nn, r.n) for r in exact_totals(frame, {"xf": ("x", "f"), "xn": ("x", "n"), "nn": ("n", "n"), "n": "n"}, ["k"]).collect()}
    whole = lambda v: Fraction(Decimal(repr(v)))
    for k in "ab":
        mine = [r for r in rows if r[0] == k]
        want = [sum(whole(r[1]) * whole(r[2]) for r in mine), sum(whole(r[1]) * r[3] for r in mine), sum(Fraction(r[3]) ** 2 for r in mine), Fraction(sum(r[3] for r in mine))]
        assert got[k] == tuple(map(rounded, want))


def test_nulls_values_that_are_not_finite_and_empty_tables(spark):
    inf, nan = math.inf, math.nan
    rows = [(None, 1.0, None), ("a", None, 2.0), ("b", inf, 1.0), ("b", 5.0, 1.0), ("c", inf, 1.0), ("c", -inf, 1.0), ("d", nan, 1.0), ("e", 2.5, 2.0), (None, 3.0, 2.0), ("f", inf, 0.0), ("g", 1e308, 10.0), ("g", -1e308, 10.0)]
    frame = spark.createDataFrame(rows, "power string, x double, w double")
    got = {r.power: (r.x, r.place) for r in exact_totals(frame, {"x": "x", "place": ("x", "w")}, ["power"]).collect()}
    assert got[None] == (4.0, 6.0) and got["a"] == (None, None) and got["b"] == (inf, inf) and got["e"] == (2.5, 5.0) and got["g"] == (0.0, 0.0)
    assert all(math.isnan(v) for v in got["c"] + got["d"]) and got["f"][0] == inf and math.isnan(got["f"][1])
    assert exact_totals(frame.limit(0), {"x": "x"}, ["power"]).count() == 0
    assert exact_totals(frame.limit(0), {"x": "x"}).collect() == [(None,)]
    zero = exact_weighted_means(spark.createDataFrame([(1.0, 0)], "x double, households long"), ["x"])
    assert zero.first().x is None


def test_one_row_a_group_sum_and_power_is_shuffled(spark):
    """The first exchange stands behind a partial aggregate, and no task takes all rows."""
    frame = spark.range(1000).select((F.col("id") / 7).alias("x"), (F.col("id") % 3).alias("k"))
    plan = exact_totals(frame, {"x": "x"}, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan
    lines = plan.splitlines()
    last = max(i for i, x in enumerate(lines) if "Exchange" in x)
    assert any("HashAggregate" in x and "partial_sum" in x for x in lines[last + 1:])


def test_methods_are_small_enough_to_be_compiled(spark):
    """The JVM runs generated methods of 8,000 bytes and more without compiling them, some ten times slower."""
    frame = spark.range(1000).select((F.col("id") / 7).alias("x"), (F.col("id") * 1e-20).alias("y"), F.col("id").alias("n"), (F.col("id") % 3).alias("k"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the code of an adaptive plan is not made before it runs
    try:
        plan = exact_totals(frame, {"x": "x", "xn": ("x", "n"), "yn": ("y", "n"), "n": "n"}, ["k"])._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    code = getattr(getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$"), "MODULE$").codegenString(plan)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_sums_of_parts_do_not_overflow(spark):
    """Whole numbers and doubles whose parts are all nines or near it, in more rows than one long could add up."""
    n, x, most = 2**17, 9.9999999999999e21, 2**63 - 1
    frame = spark.range(0, n, 1, 1).select(F.lit(most).alias("n"), F.lit(x).alias("x"), F.lit(99999999999999).alias("nines"))
    got = exact_totals(frame, {"nn": ("n", "n"), "xn": ("x", "n"), "nines": ("nines", "nines"), "n": "n"}).first()
    whole = Fraction(Decimal(repr(x)))
    assert tuple(got) == tuple(map(rounded, (Fraction(n * most * most), n * most * whole, Fraction(n * 99999999999999**2), Fraction(n * most))))
