"""N8-N15 figure verification of narrative drafts against grounding facts.

Drafts ``(draft_id, context_id, text)`` and facts ``(context_id, path,
value_double, value_string)`` are tables; the check is a Spark job:

* N8/N9 - figures are extracted with ``regexp_extract_all`` over the whole
  text (Java regex; the pattern below is the fixed figure grammar) and parsed
  with string functions into ``(value, tolerance)``;
* N10-N12 - the context number pool: numeric facts, numbers inside text
  facts, the x100 / /100 / x12 variants and baseline-vs-scenario deltas (a
  self-join of the facts on ``(context_id, kpi key)``); non-finite values are
  dropped, the pool is de-duplicated;
* N13 - a figure is verified when some pool number ``n`` of its context has
  ``| |f| - |n| | <= max(tol, 0.001 * max(|n|, |f|))`` (the signed test is
  implied by this one). Only the nearest pool numbers below and above ``|f|``
  matter; they are found by sorting figures and pool together, so no figure is
  ever paired with the pool;
* N14/N15 - per-draft totals, the unverified figures in text order, verdict.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.ranks import with_ranges
from cohortlens.session import materialize

# ---- fixed values: the figure grammar (currency with K/M/B suffix, signed
# percent / points, multiples, decimal durations, thousands-separated numbers,
# bare decimals), the context-number pattern and the suffix multipliers -------
FIGURE_PATTERN = (r"\$\s?\d[\d,]*\.?\d*(?:\s?[KkMmBb](?![A-Za-z]))?"
                  r"|[-+]?\d[\d,]*\.?\d*\s?(?:%|pts?\b)"
                  r"|\b\d+\.?\d*\s?x\b"
                  r"|\b\d+\.\d+\s?(?:months?|mo)\b"
                  r"|\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b"
                  r"|\b\d+\.\d+\b")
CONTEXT_NUMBER_PATTERN = r"-?\d[\d,]*\.?\d*"
UNIT_PATTERN = r"(?iU)(%|pts?|months?|mo|x)\s*$"
SUFFIX_MULTIPLIERS = {"k": 1e3, "m": 1e6, "b": 1e9}
RELATIVE_FLOOR = 0.001
UNVERIFIED_SHOWN = 6

JAVA_FIGURE_PATTERN = "(?U)" + FIGURE_PATTERN


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@functools.cache
def _digits() -> tuple[str, str]:
    """Every decimal digit of the basic plane beyond ASCII, and the ASCII digit of the same value."""
    other = [chr(c) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(other), "".join(str(unicodedata.digit(c)) for c in other)


def extract_figures(drafts: DataFrame, key_cols: list[str], text_col: str = "text") -> DataFrame:
    """N8 - ``key_cols + (pos, raw)``: every substantive figure, in text order."""
    arr = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(JAVA_FIGURE_PATTERN), 0)
    return drafts.select(*key_cols, F.posexplode(arr).alias("pos", "raw")).withColumn(
        "pos", F.col("pos") + 1)


def parse_figures(figs: DataFrame) -> DataFrame:
    """N9 - value and precision-aware tolerance (half a unit of the quoted precision x multiplier).

    White space and digits of any script count as such. A figure that is no number for all that keeps its row with a null
    value, so it is counted and never traced.
    """
    ascii_digits = F.translate(F.col("raw"), *_digits())
    s = _strip(F.regexp_replace(F.regexp_replace(_strip(ascii_digits), r"^\$+", ""), r"[,+]", ""))
    last = F.lower(F.substring(s, -1, 1))
    mult = F.coalesce(F.create_map(*[x for k, v in SUFFIX_MULTIPLIERS.items() for x in (F.lit(k), F.lit(v))])[last],
                      F.lit(1.0))
    has_suffix = last.isin(*SUFFIX_MULTIPLIERS)
    body = F.when(has_suffix, F.expr("substring(__s, 1, length(__s) - 1)")).otherwise(F.col("__s"))
    out = figs.withColumn("__s", s).withColumns({"__mult": mult, "__body": body})
    num = _strip(F.regexp_replace(F.col("__body"), UNIT_PATTERN, ""))
    out = out.withColumn("__num", num)
    decimals = F.when(F.col("__num").contains("."), F.length(F.split(F.col("__num"), r"\.").getItem(1))).otherwise(0)
    out = out.withColumns({
        "value": F.col("__num").try_cast("double") * F.col("__mult"),
        "tol": F.lit(0.5) * F.pow(F.lit(10.0), -decimals) * F.col("__mult"),
    })
    return out.drop("__s", "__mult", "__body", "__num")


def context_pool(facts: DataFrame) -> DataFrame:
    """N10-N12 - ``(context_id, n)``: context numbers with derived variants, finite, de-duplicated."""
    numeric = facts.where(F.col("value_double").isNotNull()).select("context_id", F.col("value_double").alias("n"))
    in_text = (facts.where(F.col("value_string").isNotNull())
               .select("context_id", F.explode(F.regexp_extract_all("value_string", F.lit(CONTEXT_NUMBER_PATTERN), 0))
                       .alias("tok"))
               .select("context_id", F.regexp_replace("tok", ",", "").try_cast("double").alias("n"))
               .where(F.col("n").isNotNull()))
    base = numeric.unionByName(in_text)
    variants = base.select("context_id", F.explode(F.array(
        F.col("n"), F.col("n") * 100.0, F.col("n") / 100.0, F.col("n") * 12.0)).alias("n"))
    key = F.regexp_extract("path", r"^(?:baseline|scenario)_kpis\.([^.\[]+)$", 1)
    kp = facts.where(F.col("value_double").isNotNull()).withColumn("__k", key).where(F.col("__k") != "")
    b = kp.where(F.col("path").startswith("baseline_kpis.")).select("context_id", "__k", F.col("value_double").alias("bv"))
    sc = kp.where(F.col("path").startswith("scenario_kpis.")).select("context_id", "__k",
                                                                     F.col("value_double").alias("sv"))
    d = b.join(sc, ["context_id", "__k"])
    diff = F.col("sv") - F.col("bv")
    pct = (F.col("sv") / F.col("bv") - 1.0) * 100.0
    deltas = d.select("context_id", F.explode(F.concat(
        F.array(diff, F.abs(diff), diff * 100.0, F.abs(diff) * 100.0),
        F.when(F.col("bv") != 0, F.array(pct, F.abs(pct), pct / 100.0)).otherwise(F.array().cast("array<double>")),
    )).alias("n"))
    pool = variants.unionByName(deltas)
    finite = F.col("n").isNotNull() & ~F.isnan("n") & (F.abs("n") != F.lit(float("inf")))
    return pool.where(finite).select("context_id", (F.col("n") + F.lit(0.0)).alias("n")).distinct()


def nearest_numbers(figs: DataFrame, pool: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(context_id, size, below, above)``: for each magnitude quoted in a context its nearest pool magnitudes.

    Quoted and pool magnitudes are sorted together in ranges of ``(context, magnitude)`` that Spark cuts where the rows are, so a
    crowded stretch of one context is many ranges. The last pool number before and the first behind a quoted one are its
    neighbours; a range's edges are carried over from the extremes of the ranges beside it (one row per context and
    range). Each distinct magnitude is one row: nothing is paired, however large a context is.
    """
    quoted = figs.where(F.col("value").isNotNull()).select("context_id", F.abs("value").alias("size"), F.lit(1).alias("quoted"))
    known = pool.select("context_id", F.abs("n").alias("size"), F.lit(0).alias("quoted"))
    rows = with_ranges(quoted.unionByName(known).distinct(), ["context_id", "size"], "range", ranges)
    number = F.when(F.col("quoted") == 0, F.col("size"))
    edges = rows.groupBy("context_id", "range").agg(F.max(number).alias("top"), F.min(number).alias("bottom"))
    beside = Window.partitionBy("context_id").orderBy("range")
    edges = edges.select("context_id", "range",
                         F.last("top", True).over(beside.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
                         F.first("bottom", True).over(beside.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    inside = Window.partitionBy("context_id", "range").orderBy("size", "quoted")
    near = rows.withColumns({"last": F.last(number, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
                             "next": F.first(number, True).over(inside.rowsBetween(0, Window.unboundedFollowing))})
    return near.where("quoted = 1").join(edges, ["context_id", "range"]).select(
        "context_id", "size", F.coalesce("last", "earlier").alias("below"), F.coalesce("next", "later").alias("above"))


def match_figures(figs: DataFrame, pool: DataFrame, key_cols: list[str]) -> DataFrame:
    """N13 - figures with a ``verified`` flag.

    The tolerance never favours a number that is farther away on the same side, so a figure is verified exactly when the
    nearest pool number below or above its magnitude is within tolerance.
    """
    near = nearest_numbers(figs, pool).withColumnRenamed("context_id", "__c")
    a = F.abs(F.col("value"))

    def within(n: str) -> Column:
        return F.coalesce(F.abs(a - F.col(n)) <= F.greatest(F.col("tol"), F.lit(RELATIVE_FLOOR) * F.greatest(F.col(n), a)), F.lit(False))

    j = figs.join(near, (F.col("context_id") == F.col("__c")) & (a == F.col("size")), "left")
    return j.select(*key_cols, "pos", "raw", (within("below") | within("above")).alias("verified"))


def stored_pool(facts: DataFrame) -> DataFrame:
    """The number pool of all contexts in ``facts``, written once; a context without a finite number has one row with a null."""
    contexts = facts.select("context_id", F.lit(None).cast("double").alias("n")).distinct()
    return materialize(context_pool(facts).unionByName(contexts), "context_pool")


def verify_drafts(drafts: DataFrame, facts: DataFrame | None, pool: DataFrame | None = None) -> DataFrame:
    """N8-N15 end to end: one row per draft with totals, unverified figures and the verdict line.

    A draft with empty text or without any fact in its context has 0 figures
    (nothing is checked against an empty context). Drafts are unioned with
    their checked figures and aggregated once, so drafts without figures keep
    their row without a join back. Drafts that share an id are told apart by
    their text; a draft that comes twice gives two equal rows. ``pool`` is what ``stored_pool`` wrote for the
    facts, for callers that verify many batches against them.
    """
    ids = ["draft_id", "context_id"]
    keys = [*ids, "__text"]
    pool = stored_pool(facts) if pool is None else pool
    contexts = pool.where(F.col("n").isNull()).select("context_id")
    pool = pool.where(F.col("n").isNotNull())
    told = drafts.withColumn("__text", F.md5(F.coalesce("text", F.lit(""))))
    figs = parse_figures(extract_figures(told.join(contexts, "context_id", "left_semi"), keys))
    checked = match_figures(figs, pool, keys)
    empty = told.select(*keys, F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("raw"),
                        F.lit(None).cast("boolean").alias("verified"))
    per = checked.unionByName(empty).groupBy(*keys).agg(
        F.count_if(F.col("pos").isNull()).alias("__copies"),
        F.count("pos").alias("total"),
        F.coalesce(F.sum(F.col("verified").cast("int")), F.lit(0)).cast("bigint").alias("verified"),
        F.array_sort(F.collect_set(F.when(~F.col("verified"), F.struct("pos", "raw")))).alias("__u"),
    )
    each = per.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))))
    out = each.select(*ids, *[F.expr(f"{c} div __copies").alias(c) for c in ("total", "verified")],
                      F.transform("__u", lambda s: s["raw"]).alias("unverified"))
    return out.withColumn("verdict", verdict_line())


def verdict_line() -> Column:
    """N15 - all traced / n of total untraced (first six named)."""
    n_unv = F.size("unverified")
    shown = F.array_join(F.transform(F.slice("unverified", 1, UNVERIFIED_SHOWN), lambda u: F.concat(F.lit("`"), u, F.lit("`"))), ", ")
    return (F.when((F.col("total") > 0) & (n_unv == 0),
                   F.format_string("all %d figures cited trace to the model outputs", F.col("total")))
            .when(n_unv > 0, F.format_string("%d of %d figures could not be traced directly to the model outputs: %s",
                                              n_unv, F.col("total"), shown)))
