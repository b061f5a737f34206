"""S1, S2, S5, S7 - cohort/initiative files in, result tables out.

CSV text is read as strings and typed by expression: the missing-value
spellings that pandas documents become NULL and ``try_cast`` turns unparsable
cells into NULL instead of failing the job, so the validation step can count
and drop them like any other missing value. Quoted cells may hold doubled
quotes, commas and line breaks. Household counts are read as DOUBLE, so a
fractional count is kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.schema import COHORT_SCHEMA
from cohortlens.session import table_path

# ---- fixed values: spellings read as missing (pandas' documented list) ------
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
             "NULL", "NaN", "None", "n/a", "nan", "null"]

# one dialect for reading and writing: a quote inside a quoted cell is doubled
CSV_DIALECT = {"header": "true", "quote": '"', "escape": '"'}
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"
RECORD = "__record"


def _typed(col_name: str, dtype: T.DataType) -> F.Column:
    raw = F.col(f"`{col_name}`")
    if isinstance(dtype, T.StringType):
        return F.when(raw.isin(NA_TOKENS), F.lit(None)).otherwise(raw).alias(col_name)
    number = F.trim(raw)
    number = F.when(number.rlike(NUMBER), number)  # a cast alone would also take a suffix of a type
    return number.try_cast("double" if isinstance(dtype, T.LongType) else dtype.simpleString()).alias(col_name)


def _read_text_cells(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """Every cell as text, under the header's names without a byte-order mark or outer spaces, and RECORD: the text of a row
    that has another number of cells than the header, null for all others.

    ``line_breaks``: cells may hold line breaks. Then a file is one task; without, large files are split.
    """
    reader = spark.read.options(**CSV_DIALECT).option("multiLine", line_breaks).option("inferSchema", False)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, RECORD]])
    raw = (reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD).option("columnPruning", False)
           .schema(schema).csv(path))
    return raw.select(*[F.col(f"`{c}`").alias(c.lstrip("\ufeff").strip()) for c in names], RECORD)


def _cells(record: F.Column) -> F.Column:
    """Cells of the text of a row: commas outside quotes, and one."""
    return F.regexp_count(F.regexp_replace(record, '"(?:[^"]|"")*"', ""), F.lit(",")) + 1


def _accepted(raw: DataFrame) -> F.Column:
    """A row with too few cells is read as if the rest were empty; one with too many is rejected."""
    return F.col(RECORD).isNull() | (_cells(F.col(RECORD)) <= len(raw.columns) - 1)


def read_cohort_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """S1 - a cohort CSV with a header row; required columns typed, extra columns kept as text.

    Rows with more cells than the header are left out; ``rejected_rows`` has them. Text cells keep their spaces.
    """
    raw = _read_text_cells(spark, path, line_breaks)
    types = {f.name: f.dataType for f in COHORT_SCHEMA.fields}
    return raw.where(_accepted(raw)).select(*[_typed(c, types[c]) if c in types else F.col(f"`{c}`") for c in raw.columns if c != RECORD])


def rejected_rows(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """S1 - ``(reason, text)`` of the rows of a CSV that ``read_cohort_csv`` leaves out."""
    raw = _read_text_cells(spark, path, line_breaks)
    bad = raw.where(~_accepted(raw) & (F.length(F.coalesce(F.col(f"`{raw.columns[0]}`"), F.lit(""))) >= 0))  # Spark refuses to read the text alone
    reason = F.format_string(f"%d cells, {len(raw.columns) - 1} columns", _cells(F.col(RECORD)))
    return bad.select(reason.alias("reason"), F.col(RECORD).alias("text"))


def read_cohort_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ensure_dataset(spark: SparkSession, path: str, build) -> DataFrame:
    """S2 - create the default dataset if absent, then read it.

    It is written to a folder beside ``path`` and renamed when it is complete, and only a folder with the writer's success marker
    counts as present: what a lost driver left half-written is built again. Of two drivers that build at once one wins.
    A folder without a marker that holds anything but Parquet files is left alone with an error.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    if fs.exists(at(f"{path}/_SUCCESS")):
        return spark.read.parquet(path)
    staging = f"{path}.building-{uuid.uuid4().hex}"
    build(spark).write.parquet(staging)
    if fs.exists(at(path)) and not fs.exists(at(f"{path}/_SUCCESS")):
        other = [f.getPath().getName() for f in fs.listStatus(at(path))]
        other = [n for n in other if not (n.startswith(("_", ".", "part-")) or "=" in n)]
        if other:
            fs.delete(at(staging), True)
            raise ValueError(f"{path} is no dataset: it has no success marker, but {other[0]}")
        fs.delete(at(path), True)
    if fs.exists(at(path)) or not fs.rename(at(staging), at(path)):  # another driver was faster
        fs.delete(at(staging), True)
    return spark.read.parquet(path)


def share_upload(spark: SparkSession, path: str) -> str:
    """S5 - where executors find an uploaded file: the driver's copy, streamed by the file system into the shared folder.

    It goes when the application ends. A path that names a file system is shared already and is returned as it is.
    """
    if "://" in path:
        return path
    at = spark._jvm.org.apache.hadoop.fs.Path
    target = at(table_path(spark, f"upload_{uuid.uuid4().hex}.csv"))
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).copyFromLocalFile(False, True, at(path), target)
    return target.toString()


def read_initiatives_csv(spark: SparkSession, path: str) -> DataFrame:
    """S5 - an uploaded/edited initiative table (any subset of the 15 columns; BOM tolerated)."""
    renamed = _read_text_cells(spark, path).drop(RECORD)
    return renamed.select(*[F.when(F.trim(F.col(f"`{c}`")).isin(NA_TOKENS), F.lit(None))
                            .otherwise(F.col(f"`{c}`")).alias(c) for c in renamed.columns])


def write_results(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite",
                  fmt: str = "parquet", touched_only: bool = False, rows_per_file: int = 0) -> None:
    """S7 - write a result table (parquet by default, optionally partitioned, e.g. by market).

    Rows of a partition are brought together first, and large partitions split, so a task writes few partitions and files are of
    about the size that adaptive execution advises, with ``rows_per_file`` rows at most if given. ``touched_only``: the
    partitions that ``df`` has rows of are replaced, all others of the table stay.
    """
    if touched_only and not partition_by:
        raise ValueError("only a partitioned table can be replaced in part")
    out = df.hint("rebalance", *partition_by) if partition_by else df
    w = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(**CSV_DIALECT)
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic" if touched_only else "static")
    w.save(path)
