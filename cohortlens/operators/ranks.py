"""W1 exact global percentile rank (average ties) and W8 min-max normalisation.

``rank(pct=True)`` semantics: ``pr(x) = (#less + (#equal + 1) / 2) / N`` over the
non-missing values of a column. Neither ``percent_rank`` nor ``cume_dist`` is
that, and an un-partitioned window would funnel the table through one task, so
the rank is computed as a distributed job:

1. unpivot the ranked columns to ``(metric, value)`` and count each distinct
   value (one shuffle, combined map-side; a heavily tied value is one row);
2. when a metric has more distinct values than one window partition should
   hold, Spark range-partitions the ``(metric, value)`` rows into as many ranges
   as ``rows_per_bucket`` asks for and the rows are written with their range, so
   a range's size is bounded whatever the number of values (``with_ranges``);
3. range totals -> running offsets over one row per range and metric;
4. running count inside each ``(metric, range)`` window;
5. join the rank back on the value itself (a rank is a function of the
   value). Columns whose lookups fit ``BROADCAST_ROWS`` together - measured
   distinct counts, or the validated row count - share ONE broadcast that
   Spark reuses for every join; high-cardinality columns are shuffle joins
   (AQE splits a skewed value), or, from ``LONG_FORM_MIN_COLUMNS`` of them on,
   one narrow long-form join + pivot keyed by a deterministic row id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import materialize

ROWS_PER_BUCKET = 1_000_000
BROADCAST_ROWS = 2_000_000
# from this many high-cardinality columns on, one narrow long-form join + pivot replaces one wide shuffle
# join per column (measured: 3 columns x 2M rows are faster as per-column joins)
LONG_FORM_MIN_COLUMNS = 4
# long-form rows that one task puts together again: this bounds its memory
LONG_ROWS_PER_TASK = 2_000_000


def _long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    narrow = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = narrow.unpivot([], columns, "metric", "value")
    # +0.0 folds -0.0 into 0.0; missing values are not ranked
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).select(
        "metric", (F.col("value") + F.lit(0.0)).alias("value"))


def rank_table(df: DataFrame, columns: list[str], max_rows: int | None = None, rows_per_bucket: int | None = None,
               broadcast_rows: int | None = None) -> tuple[DataFrame, dict[str, int], dict[str, int]]:
    """Distributed rank lookup ``(metric, value, pr)``.

    Returns the lookup, the number of distinct values and that of ranked rows
    per column (upper bounds when not measured). Value counts and lookup are parquet
    tables in the shared folder: the source is read once, and the statistics,
    cut-point, window and join jobs read the tables.

    ``max_rows`` - a known bound on the input rows (e.g. from validation).
    When every column is then known to fit one window partition and the whole
    lookup fits a broadcast, no statistics job is needed.
    """
    spark = df.sparkSession
    rows_per_bucket = ROWS_PER_BUCKET if rows_per_bucket is None else rows_per_bucket
    broadcast_rows = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    vc = _long_values(df, columns).groupBy("metric", "value").agg(F.count(F.lit(1)).alias("cnt"))
    if max_rows is not None and max_rows <= rows_per_bucket and max_rows * len(columns) <= broadcast_rows:
        # nothing written: the lookup is computed once, inside the one broadcast every join reuses
        w_cum = Window.partitionBy("metric").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        n = F.sum("cnt").over(Window.partitionBy("metric"))
        ranked = vc.select("metric", "value", ((F.sum("cnt").over(w_cum) - F.col("cnt") + (F.col("cnt") + 1) / 2.0)
                                               / n).alias("pr"))
        return ranked, {c: max_rows for c in columns}, {c: max_rows for c in columns}
    vc = materialize(vc, "rank_counts")  # read by the statistics, cut-point and window jobs
    stats = {r["metric"]: (int(r["n_distinct"]), int(r["n"]))
             for r in vc.groupBy("metric").agg(F.count(F.lit(1)).alias("n_distinct"),
                                                F.sum("cnt").alias("n")).collect()}
    meta_schema = T.StructType([T.StructField("metric", T.StringType()), T.StructField("n", T.LongType())])
    meta = spark.createDataFrame([(m, stats[m][1]) for m in stats], meta_schema)
    ranges = math.ceil(sum(nd for nd, _ in stats.values()) / rows_per_bucket) if any(nd > rows_per_bucket for nd, _ in stats.values()) else 1
    # meta has one row per ranked column (bounded by the column list)
    vcb = with_ranges(vc, ["metric", "value"], "bucket", ranges).join(F.broadcast(meta), "metric")
    totals = vcb.groupBy("metric", "bucket").agg(F.sum("cnt").alias("bcnt"))
    w_off = Window.partitionBy("metric").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("bcnt").over(w_off), F.lit(0))).drop("bcnt")
    # offsets: one row per range and ranked column
    w_cum = Window.partitionBy("metric", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (vcb.join(offsets, ["metric", "bucket"])
              .withColumn("cum", F.sum("cnt").over(w_cum))
              .select("metric", "value",
                      ((F.col("offset") + F.col("cum") - F.col("cnt") + (F.col("cnt") + 1) / 2.0)
                       / F.col("n")).alias("pr")))
    distinct, rows = ({c: stats.get(c, (0, 0))[i] for c in columns} for i in (0, 1))
    return materialize(ranked, "rank_lookup"), distinct, rows


def with_ranges(df: DataFrame, keys: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` written in ranges of ``keys``, with the number of each row's range; ranges ascend and equal keys share one.

    Spark draws the cuts from a sample of the rows, so a crowded stretch of values gets as many ranges as its rows need. The
    range is written with the row: later jobs and lost executors read the same. ``ranges`` None leaves their number to the session.
    """
    if ranges == 1:
        return df.withColumn(name, F.lit(0))
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    dealt = df.repartitionByRange(ranges, *cols) if ranges else df.repartitionByRange(*cols)
    return materialize(dealt.withColumn(name, F.spark_partition_id()), "ranges")


def ordinal_rank(df: DataFrame, order: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """W9 - the position (from 1) of each row in a total order, for tables of any length.

    Rows are numbered inside ranges of the order; a range starts behind the rows of the ranges before it, which one row per
    range tells. No task holds more than a range.
    """
    ranged = with_ranges(df, order, "__range", ranges)
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("rows"))
    sizes = counts.agg(F.array_sort(F.collect_list(F.struct("__range", "rows"))).alias("s"))  # one entry per range
    before = F.transform("s", lambda x, i: F.struct(x["__range"].alias("__range"), F.aggregate(
        F.slice("s", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, y: a + y["rows"]).alias("__before")))
    starts = F.broadcast(sizes.select(F.inline(before)))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn(name, inside).join(starts, "__range").withColumn(name, (F.col(name) + F.col("__before")).cast("bigint")).drop("__range", "__before")


def _broadcast_join_back(df: DataFrame, lookup: DataFrame, columns: list[str], name_of: dict) -> DataFrame:
    """All small-lookup columns joined against the same broadcast relation, projected once at the end.

    Every join reads the same broadcast plan, which Spark ships once and
    reuses (AQE shows it as a reused exchange).
    """
    lk = F.broadcast(lookup.select(F.struct("metric", "value").alias("__rk"), F.col("pr").alias("__pr")))
    base_cols = [F.col(f"__src.`{c}`") for c in df.columns]
    out = df.alias("__src")
    for i, c in enumerate(columns):
        key = F.struct(F.lit(c).alias("metric"), (F.col(f"__src.`{c}`").cast("double") + F.lit(0.0)).alias("value"))
        out = out.join(lk.alias(f"__l{i}"), key == F.col(f"__l{i}.__rk"), "left")
    return out.select(*base_cols, *[F.col(f"__l{i}.__pr").alias(name_of[c]) for i, c in enumerate(columns)])


def _broadcast_split(distinct: dict[str, int], columns: list[str], broadcast_rows: int) -> tuple[list[str], list[str]]:
    """Columns whose lookups fit one broadcast together (fewest distinct values first), and the rest."""
    small, total = [], 0
    for c in sorted(columns, key=lambda c: distinct.get(c, 0)):
        if total + distinct.get(c, 0) <= broadcast_rows:
            small.append(c)
            total += distinct.get(c, 0)
    return [c for c in columns if c in small], [c for c in columns if c not in small]


def with_percentile_ranks(df: DataFrame, columns: list[str], names: list[str] | None = None,
                          max_rows: int | None = None, row_id: str | None = None, rows_per_bucket: int | None = None,
                          broadcast_rows: int | None = None) -> DataFrame:
    """Append ``pr`` (0..1] for each column; NULL for missing values.

    Columns whose lookups fit ``BROADCAST_ROWS`` together are joined against
    the SAME broadcast relation keyed by ``struct(metric, value)``, so Spark
    ships one broadcast and reuses it. High-cardinality columns are joined in
    long form when ``row_id`` (a deterministic row key) is given: one shuffle
    of the narrow ``(row_id, metric, value)`` rows against the lookup, a pivot
    back per row, and a single join of the wide table on ``row_id`` - instead of
    one wide shuffle per column (used from ``LONG_FORM_MIN_COLUMNS`` such
    columns on). Otherwise each such column is a shuffle join on its value
    (AQE splits a skewed value).
    ``rows_per_bucket`` and ``broadcast_rows`` choose among these plans by size; the result is the same.
    """
    names = names or [f"{c}_pr" for c in columns]
    name_of = dict(zip(columns, names))
    broadcast_rows = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    ranks, distinct, rows = rank_table(df, columns, max_rows, rows_per_bucket, broadcast_rows)
    small, large = _broadcast_split(distinct, columns, broadcast_rows)
    out = df
    if small:
        part = ranks if not large else ranks.where(F.col("metric").isin(small))
        out = _broadcast_join_back(df, part, small, name_of)
    if len(large) >= LONG_FORM_MIN_COLUMNS and row_id is not None:
        long = (
            df.select(row_id, F.explode(F.array(*[
                F.struct(F.lit(c).alias("metric"), (F.col(c).cast("double") + F.lit(0.0)).alias("value"))
                for c in large])).alias("__kv"))
            .select(row_id, "__kv.metric", "__kv.value")
            .where(F.col("value").isNotNull() & ~F.isnan("value")))
        # dealt before they are put together: a partial aggregate of unique ids would hold all rows of its task for nothing
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(sum(rows[c] for c in large) / LONG_ROWS_PER_TASK))
        hit = long.join(ranks.where(F.col("metric").isin(large)), ["metric", "value"]).select(row_id, "metric", "pr").repartition(tasks, row_id)
        wide = hit.groupBy(row_id).agg(*[F.max(F.when(F.col("metric") == c, F.col("pr"))).alias(name_of[c]) for c in large])
        return out.repartition(tasks, row_id).join(wide, row_id, "left")
    for i, c in enumerate(large):
        key = f"__rk{i}"
        lookup = ranks.where(F.col("metric") == c).select(F.col("value").alias(key), F.col("pr").alias(name_of[c]))
        out = out.join(lookup, (F.col(c).cast("double") + F.lit(0.0)) == F.col(key), "left").drop(key)
    return out


def percentile_rank_window(df: DataFrame, column: str, name: str) -> DataFrame:
    """Reference form of W1 over one un-partitioned window.

    Only for inputs whose size is bounded by construction (a few hundred
    parameter rows, or <= 1,001 rounded scores); it gathers the input into a
    single partition.
    """
    w_all = Window.partitionBy(F.lit(1))
    w_val = Window.partitionBy(F.lit(1)).orderBy(column)
    w_eq = Window.partitionBy(column)
    valid = F.col(column).isNotNull() & ~F.isnan(column)
    base = df.where(valid)
    ranked = base.withColumn(
        name, (F.rank().over(w_val) + (F.count(F.lit(1)).over(w_eq) - 1) / 2.0) / F.count(F.lit(1)).over(w_all))
    return ranked.unionByName(df.where(~valid).withColumn(name, F.lit(None).cast("double")))


def minmax_normalize(df: DataFrame, column: str, name: str) -> DataFrame:
    """W8 for one column."""
    return minmax_normalized(df, {column: name})


def minmax_normalized(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """W8 - ``(x - min) / (max - min)`` of each column under its new name; a range under 1e-12 gives 0.5 everywhere.

    The extremes of all columns are one aggregate, read as a scalar: no window, whatever the length of the table.
    """
    ends = df.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).alias("e")).scalar()
    lo, hi = (lambda c: ends[f"lo_{c}"]), (lambda c: ends[f"hi_{c}"])
    return df.withColumns({name: F.when(hi(c) - lo(c) < 1e-12, F.lit(0.5)).otherwise((F.col(c) - lo(c)) / (hi(c) - lo(c)))
                           for c, name in columns.items()})
