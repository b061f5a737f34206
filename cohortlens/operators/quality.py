"""V1-V7 - one-pass data-quality validation of a cohort table.

``validate`` returns the cleaned table (lazy) and a tidy issue table
``(seq, severity, check, column, n_rows, message)``. All counts come from a
single aggregate over the input, so validation costs one scan whatever the
table size. Missing-value counts are taken before dropping; the range checks
count only complete rows (they run after the drop in the model definition).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.numeric import clip, clip_lower
from cohortlens.schema import NON_NEGATIVE_COLUMNS, RATE_COLUMNS, REQUIRED_COLUMNS

ISSUE_SCHEMA = T.StructType([
    T.StructField("seq", T.IntegerType()),
    T.StructField("severity", T.StringType()),
    T.StructField("check", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("message", T.StringType()),
])


@dataclass
class Validation:
    clean: DataFrame
    issues: DataFrame
    errors: list[str]
    warnings: list[str]
    rows_in: int
    rows_out: int

    @property
    def ok(self) -> bool:
        return not self.errors


def _missing(c: str, dtype) -> F.Column:
    col = F.col(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def missing_columns(df: DataFrame) -> list[str]:
    """V1 - required columns absent from the input, in required order (metadata only)."""
    present = set(df.columns)
    return [c for c in REQUIRED_COLUMNS if c not in present]


def quality_counts(df: DataFrame) -> DataFrame:
    """One-row aggregate with every count the checks need (V2, V4-V7)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    complete = None
    for c in REQUIRED_COLUMNS:
        m = ~_missing(c, types[c])
        complete = m if complete is None else complete & m
    aggs = [F.count(F.lit(1)).alias("rows_in")]
    aggs += [F.sum(F.when(_missing(c, types[c]), 1).otherwise(0)).alias(f"na__{c}") for c in REQUIRED_COLUMNS]
    aggs.append(F.sum(F.when(complete, 1).otherwise(0)).alias("rows_out"))
    aggs += [
        F.sum(F.when(complete & ((F.col(c) < 0) | (F.col(c) > 1)), 1).otherwise(0)).alias(f"rate__{c}")
        for c in RATE_COLUMNS
    ]
    aggs += [F.sum(F.when(complete & (F.col(c) < 0), 1).otherwise(0)).alias(f"neg__{c}") for c in NON_NEGATIVE_COLUMNS]
    # V6 compares month 12 with month 1 *after* the [0, 1] clip
    m12 = F.least(F.greatest(F.col("month_12_retention"), F.lit(0.0)), F.lit(1.0))
    m1 = F.least(F.greatest(F.col("month_1_retention"), F.lit(0.0)), F.lit(1.0))
    aggs.append(F.sum(F.when(complete & (m12 > m1), 1).otherwise(0)).alias("inverted"))
    return df.agg(*aggs)


def clean_projection(df: DataFrame) -> DataFrame:
    """V3 drop incomplete rows, V4/V5 clip; extra columns pass through untouched."""
    types = {f.name: f.dataType for f in df.schema.fields}
    complete = None
    for c in REQUIRED_COLUMNS:
        m = ~_missing(c, types[c])
        complete = m if complete is None else complete & m
    out = df.where(complete)
    clipped = {c: clip(c, 0.0, 1.0) for c in RATE_COLUMNS}
    for c in NON_NEGATIVE_COLUMNS:
        if c == "households":
            clipped[c] = F.greatest(F.col(c), F.lit(0)).cast(types[c])
        else:
            clipped[c] = clip_lower(c, 0.0)
    return out.withColumns(clipped)


def issues_from_counts(row: Row) -> list[tuple]:
    """Turn the one-row counts into ordered issue records (check order == message order)."""
    out = []
    seq = 0

    def add(sev, check, col, n, msg):
        nonlocal seq
        seq += 1
        out.append((seq, sev, check, col, int(n), msg))

    for c in REQUIRED_COLUMNS:
        n = row[f"na__{c}"]
        if n:
            add("warning", "missing_values", c, n, f"`{c}` has {n} missing value(s); affected rows were dropped.")
    for c in RATE_COLUMNS:
        n = row[f"rate__{c}"]
        if n:
            add("warning", "rate_range", c, n, f"`{c}` has {n} value(s) outside [0, 1]; clipped.")
    for c in NON_NEGATIVE_COLUMNS:
        n = row[f"neg__{c}"]
        if n:
            add("warning", "non_negative", c, n, f"`{c}` has {n} negative value(s); clipped to 0.")
    n = row["inverted"]
    if n:
        add("warning", "inverted_retention", "month_12_retention", n,
            f"{n} row(s) have month-12 retention above month-1 retention — check the retention curve inputs.")
    if not row["rows_out"]:
        add("error", "empty_result", None, 0, "No valid rows remain after cleaning.")
    return out


def validate(df: DataFrame, rejected: DataFrame | None = None) -> Validation:
    """Run V1-V7. One Spark action (the counts aggregate) unless V1 fails first.

    ``rejected``: rows that the reader left out; their number is the first issue.
    """
    spark = df.sparkSession
    missing = missing_columns(df)
    if missing:
        msg = f"Missing required columns: {', '.join(missing)}"
        issues = spark.createDataFrame([(1, "error", "missing_columns", ", ".join(missing), len(missing), msg)],
                                       ISSUE_SCHEMA)
        return Validation(df, issues, [msg], [], -1, -1)
    row = quality_counts(df).first()
    recs = issues_from_counts(row)
    left_out = rejected.count() if rejected is not None else 0
    if left_out:
        first = (1, "warning", "malformed_rows", None, left_out, f"{left_out} malformed row(s) were not read.")
        recs = [first, *[(r[0] + 1, *r[1:]) for r in recs]]
    issues = spark.createDataFrame(recs, ISSUE_SCHEMA)
    errors = [r[5] for r in recs if r[1] == "error"]
    warnings = [r[5] for r in recs if r[1] == "warning"]
    return Validation(clean_projection(df), issues, errors, warnings, int(row["rows_in"]), int(row["rows_out"] or 0))


def issue_counts_long(df: DataFrame) -> DataFrame:
    """The issue counts as a distributed long table ``(check, column, n_rows)`` (no driver round trip).

    Same single aggregate as :func:`validate`, unpivoted with ``stack``; zero
    counts are kept so the shape is fixed.
    """
    counts = quality_counts(df)
    entries = ([("missing_values", c, f"na__{c}") for c in REQUIRED_COLUMNS]
               + [("rate_range", c, f"rate__{c}") for c in RATE_COLUMNS]
               + [("non_negative", c, f"neg__{c}") for c in NON_NEGATIVE_COLUMNS]
               + [("inverted_retention", "month_12_retention", "inverted"),
                  ("rows_remaining", "*", "rows_out"), ("rows_read", "*", "rows_in")])
    args = ", ".join(f"'{chk}', '{col}', CAST(`{src}` AS BIGINT)" for chk, col, src in entries)
    return counts.selectExpr(f"stack({len(entries)}, {args}) AS (`check`, `column`, n_rows)")
