"""Line dedup by site-relative frequency.

Pages are grouped by host; rows of one host and text are one page, so a group of copies beyond the ratio does not take its own
lines and leave no document. For each line, the pages of the host that contain it are divided by all pages of the
host; a line beyond the boilerplate ratio is dropped from every page of that host.

Only line digests are shuffled for counting, added up per task first, so a host or a line with a third of the rows
is a few rows per task. A host has at most 1 / ratio times as many boilerplate lines as its pages have lines on average, so their
digests are few; up to ``BROADCAST_BYTES`` of them are sent to every task and texts are not shuffled at all. Beyond that the
decisions are joined to the pages by host and text digest; adaptive execution splits the rows of a text that many pages share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import fresh, stored

#: Share of a host's pages beyond which a line is boilerplate.
MAX_RATIO = 0.08
#: Pages of a host that must hold a line before it can be boilerplate.
MIN_PAGES = 5
#: Boilerplate lines (digest, host and some 32 bytes each) are sent to every task up to so many bytes, measured when they are known.
BROADCAST_BYTES = 64 << 20


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(value: Column) -> Column:
    return F.unhex(F.md5(value))


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, n_pages, host_pages) of the lines to drop; ``pages`` has host, page (digest of the text) and text, ``line`` is a digest.

    A line counts once per page, and the rows of a host with equal texts are one page. Lines of white space alone are never boilerplate.
    """
    lines = pages.select("host", "page", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line")).where(F.col("line").rlike(r"\S"))
    held = lines.select("host", "page", _digest(F.col("line")).alias("line")).distinct()
    counts = held.groupBy("host", "line").agg(F.count("*").alias("n_pages"))
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    return counts.where(F.col("n_pages") >= min_pages).join(totals, "host").where(F.col("n_pages") > max_ratio * F.col("host_pages"))


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All rows and columns of ``docs``, the text without boilerplate lines; with n_lines and n_dropped.

    Names that ``docs`` has already get underscores added. Pages with a null host form one host of their own. A null text
    stays null (0 lines); those of a host count as one page. A page that loses all its lines has an empty text. Repeated rows are
    one page and each give a row. The order of the lines that stay is kept.
    """
    h, n_lines, n_dropped, gone = (fresh(docs, x) for x in ("__host", "n_lines", "n_dropped", "__gone"))
    keyed = docs.withColumn(h, F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")))
    pages = keyed.select(F.col(h).alias("host"), _digest(F.col(text)).alias("page"), F.col(text).alias("text"))
    boiler = stored(boilerplate(pages, max_ratio, min_pages).select("host", "line"), "boilerplate")
    held = boiler.agg(F.coalesce(F.sum(F.length("host") + F.length("line") + 32), F.lit(0))).first()[0]
    if held <= BROADCAST_BYTES:
        joined = _with_lines_of_host(keyed, boiler, h, gone)
    else:
        joined = _with_lines_of_page(keyed, pages, boiler, h, text, gone)
    left = F.when(F.col(gone).isNull(), _lines(F.col(text))).otherwise(F.filter(_lines(F.col(text)), lambda x: ~F.array_contains(F.col(gone), _digest(x))))
    out = joined.withColumn(gone, left)
    return out.select(
        *[F.array_join(F.col(gone), "\n").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(F.col(text)))).cast("long").alias(n_lines),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(F.col(text))) - F.size(gone)).cast("long").alias(n_dropped),
    )


def _with_lines_of_host(keyed: DataFrame, boiler: DataFrame, h: str, gone: str) -> DataFrame:
    """``keyed`` with the digests of its host's boilerplate lines, sent to every task; no text is shuffled."""
    per_host = boiler.groupBy(F.col("host").alias("__drop_host")).agg(F.collect_list("line").alias(gone))
    return keyed.join(F.broadcast(per_host), keyed[h] == F.col("__drop_host"), "left").drop("__drop_host")


def _with_lines_of_page(keyed: DataFrame, pages: DataFrame, boiler: DataFrame, h: str, text: str, gone: str) -> DataFrame:
    """The same with the digests of the page's own boilerplate lines, joined by host and text digest."""
    lines = pages.select("host", "page", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line")).select("host", "page", _digest(F.col("line")).alias("line"))
    drops = lines.join(boiler, ["host", "line"]).groupBy("host", "page").agg(F.collect_set("line").alias(gone))
    drops = drops.select(F.col("host").alias("__drop_host"), F.col("page").alias("__drop_page"), gone)
    return keyed.join(drops, (keyed[h] == F.col("__drop_host")) & (_digest(keyed[text]) == F.col("__drop_page")), "left").drop("__drop_host", "__drop_page")


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """``docs`` with boilerplate lines of each source dropped and n_chars, where there is one, counted anew."""
    out = dedup_lines(docs).select(*[f"`{c}`" for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
