"""S6 - build the 22-column cohort table from order/customer facts.

A household is a customer; its cohort is the month of its first order.
Mapping (per customer first, then averaged over the customers of a cohort
``(first month, nation, region, market segment)``):

=============================  ===============================================
households                     customers in the cohort
activation_rate                avg(c_acctbal > 0)
first_week_hours               avg(quantity bought in the first month) / 10
first_week_app_installs        avg(line items bought in the first month)
trc_usage_rate                 avg(share of line items with return flag 'N')
subscription_conversion_rate   avg(share of orders with priority '1-URGENT')
monthly_streaming_hours        avg(total quantity) / 12
ad_supported_share             avg(share of line items with line status 'O')
ad_impressions_per_hour        16 + 100 * avg(mean discount)
cpm                            avg(mean extended price) / 2000
fill_rate                      1 - 5 * avg(mean tax)
subscription_arpu              avg(mean order total) / 20000
gross_margin                   0.5 + avg(mean discount)
month_k_retention              a_k + 0.45 * avg(has an order k..k+11 months
                               after the first), a = .40/.30/.20/.10
support_cost_per_household     0.2 + 0.005 * avg(line items)
=============================  ===============================================

Plan shape (designed for billions of line items):

1. line items are dealt by order key to as many tasks as their number asks
   for (``LINES_PER_TASK``) and aggregated per order there: a task holds a
   bounded number of orders, however large the files' splits are and in
   whichever order lines come; a hot order is one group, read as a stream;
2. orders, dealt alike, left-join those order stats on the order key (orders
   without line items still count as orders, lines without a key have none);
3. aggregate to (customer, month, part of the orders), dealt to as many tasks:
   a part is the orders of one task of step 2, so even a customer holding a
   third of all orders is added up in many tasks and leaves at most one row
   per month and part;
4. those rows are dealt by customer to as many tasks, which add them up per
   (customer, month), take the window ``min(month)`` per customer and the
   per-customer aggregate: no task's share depends on the session's partitions;
5. join customer, then the nation/region dimensions (Spark broadcasts them
   from their measured file size), and aggregate to the cohort grain.

Amounts, quantities, discounts and taxes add up as decimals (``AMOUNT``) and
the averages come from exact sums, so no measure depends on the order rows
meet in a distributed aggregate. The averaged measures have ``MEASURE_DIGITS``
decimals (rounded half-even), so shares that are equal as numbers stay ties in
the percentile ranks. Amounts that ``AMOUNT`` does not hold (1e12 and more, or
cut by more than a billionth) add up in double precision beside them; an
amount that is not finite counts as missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.functions.numeric import exact_mean, rint_round
from cohortlens.schema import KEY_COLUMNS, REQUIRED_COLUMNS

# ---- fixed values: retention base levels per observed month -----------------
RETENTION_BASE = {1: 0.40, 3: 0.30, 6: 0.20, 12: 0.10}
RETENTION_SPAN = 0.45
WINDOW_WIDTH_MONTHS = 12
MEASURE_DIGITS = 9
AMOUNT = "decimal(18,6)"
HELD_TO = 1e-9
#: Line items whose orders one task adds up and joins: this bounds its memory, whatever the splits of the files.
LINES_PER_TASK = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_index(ts_col) -> F.Column:
    """Calendar month number ``year*12 + month - 1``."""
    return F.year(ts_col) * 12 + F.month(ts_col) - 1


def month_label(m_col) -> F.Column:
    """``YYYY-MM`` text of a month number (lexical order == time order)."""
    year = F.floor(m_col / 12).cast("int")
    month = (m_col - year * 12 + 1).cast("int")
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def _amounts(c: str, name: str) -> list[F.Column]:
    """Sums of an amount: ``name`` of all that ``AMOUNT`` holds, ``name``_rest in double precision of those it would cut or not take."""
    x, held = F.col(c).cast("double"), F.col(c).try_cast(AMOUNT)
    lost = held.isNull() | (F.abs(held.cast("double") - x) > F.abs(x) * HELD_TO)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return [F.sum(F.when(~lost, held)).alias(name), F.sum(F.when(finite & lost, x)).alias(f"{name}_rest")]


def _summed(src: str, name: str) -> list[F.Column]:
    """Both sums of an amount, of the rows that have one."""
    return [F.sum(F.coalesce(F.col(src), F.lit(0))).alias(name), F.sum(f"{src}_rest").alias(f"{name}_rest")]


def _whole(name: str, where: F.Column | None = None) -> F.Column:
    """An amount's total, of the rows that ``where`` holds for; null where no row has any."""
    only = (lambda c: c) if where is None else (lambda c: F.when(where, c).otherwise(0))
    held, rest = F.sum(only(F.col(name))).cast("double"), F.sum(only(F.col(f"{name}_rest")))
    return F.coalesce(held + rest, held, rest).alias(name)


def order_tasks(lineitem: DataFrame) -> int:
    """Tasks that line items and orders are dealt to by order key; the count of a Parquet table reads its footers only."""
    return max(lineitem.sparkSession.sparkContext.defaultParallelism, -(-lineitem.count() // LINES_PER_TASK))


def customer_facts(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per customer with the per-customer quantities of the mapping."""
    tasks = order_tasks(lineitem)
    lines = lineitem.where(F.col("l_orderkey").isNotNull()).select(
        "l_orderkey", "l_quantity", "l_discount", "l_extendedprice", "l_tax",
        F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("flag_n"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("status_o"),
    ).repartition(tasks, "l_orderkey")
    per_order = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("li_n"),
        *_amounts("l_quantity", "li_qty"),
        F.sum("flag_n").alias("li_flag_n"),
        F.sum("status_o").alias("li_status_o"),
        *_amounts("l_discount", "li_disc"),
        *_amounts("l_extendedprice", "li_price"),
        *_amounts("l_tax", "li_tax"),
    )
    o = orders.select(
        F.col("o_orderkey"),
        F.col("o_custkey").alias("custkey"),
        month_index(F.col("o_orderdate")).alias("m"),
        F.col("o_totalprice"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("urgent"),
    ).repartition(tasks, "o_orderkey")
    ol = o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left").withColumn("part", F.pmod(F.hash("o_orderkey"), F.lit(tasks)))
    parts = ol.repartition(tasks, "custkey", "m", "part").groupBy("custkey", "m", "part").agg(
        F.count(F.lit(1)).alias("n_ord"),
        F.sum("urgent").alias("n_urgent"),
        *_amounts("o_totalprice", "sum_total"),
        F.sum(F.coalesce(F.col("li_n"), F.lit(0))).alias("n_li"),
        *_summed("li_qty", "qty"),
        F.sum(F.coalesce(F.col("li_flag_n"), F.lit(0))).alias("n_flag_n"),
        F.sum(F.coalesce(F.col("li_status_o"), F.lit(0))).alias("n_status_o"),
        *_summed("li_disc", "disc"),
        *_summed("li_price", "price"),
        *_summed("li_tax", "tax"),
    )
    keys = ["custkey", "m"]
    cm = parts.repartition(tasks, "custkey").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in (*keys, "part")])
    cm = cm.withColumn("m0", F.min("m").over(Window.partitionBy("custkey")))
    off = F.col("m") - F.col("m0")
    flags = [
        F.max(F.when((off >= k) & (off <= k + WINDOW_WIDTH_MONTHS - 1), 1).otherwise(0)).alias(f"ret_{k}")
        for k in RETENTION_BASE
    ]
    return cm.groupBy("custkey").agg(
        F.min("m0").alias("m0"),
        F.sum("n_ord").alias("n_ord"),
        F.sum("n_urgent").alias("n_urgent"),
        _whole("sum_total"),
        F.sum("n_li").alias("n_li"),
        _whole("qty"),
        F.sum("n_flag_n").alias("n_flag_n"),
        F.sum("n_status_o").alias("n_status_o"),
        _whole("disc"),
        _whole("price"),
        _whole("tax"),
        _whole("qty", off == 0).alias("qty_m0"),
        F.sum(F.when(off == 0, F.col("n_li")).otherwise(0)).alias("n_li_m0"),
        *flags,
    )


def cohorts_from_facts(spark: SparkSession, sf_dir: str, per_household: bool = False) -> DataFrame:
    """The cohort table (22 required columns) built from the fact tables in ``sf_dir``.

    ``per_household``: a row for each customer (``custkey``) instead of each cohort, with one household.
    """
    cust = customer_facts(read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "orders"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    per_li = lambda c: F.try_divide(F.col(c), F.col("n_li"))  # noqa: E731 - NULL when no line items
    per_ord = lambda c: F.try_divide(F.col(c), F.col("n_ord"))

    j = (cust.join(customer, cust.custkey == customer.c_custkey)
         .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    own = ["custkey"] if per_household else []
    agg = j.groupBy(
        F.col("m0"), F.col("n_name").alias("market"), F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("device_type"), *own,
    ).agg(
        F.count(F.lit(1)).alias("households"),
        exact_mean(F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0)).alias("activation_rate"),
        (exact_mean("qty_m0") / 10.0).alias("first_week_hours"),
        exact_mean(F.col("n_li_m0").cast("double")).alias("first_week_app_installs"),
        exact_mean(per_li("n_flag_n")).alias("trc_usage_rate"),
        exact_mean(per_ord("n_urgent")).alias("subscription_conversion_rate"),
        (exact_mean("qty") / 12.0).alias("monthly_streaming_hours"),
        exact_mean(per_li("n_status_o")).alias("ad_supported_share"),
        (F.lit(16.0) + F.lit(100.0) * exact_mean(per_li("disc"))).alias("ad_impressions_per_hour"),
        (exact_mean(per_li("price")) / 2000.0).alias("cpm"),
        (F.lit(1.0) - F.lit(5.0) * exact_mean(per_li("tax"))).alias("fill_rate"),
        (exact_mean(per_ord("sum_total")) / 20000.0).alias("subscription_arpu"),
        (F.lit(0.5) + exact_mean(per_li("disc"))).alias("gross_margin"),
        *[
            (F.lit(base) + F.lit(RETENTION_SPAN) * exact_mean(F.col(f"ret_{k}").cast("double"))).alias(f"month_{k}_retention")
            for k, base in RETENTION_BASE.items()
        ],
        (F.lit(0.2) + F.lit(0.005) * exact_mean(F.col("n_li").cast("double"))).alias("support_cost_per_household"),
    )
    measures = [c for c in REQUIRED_COLUMNS if c not in KEY_COLUMNS and c != "households"]
    agg = agg.withColumns({c: rint_round(F.col(c), MEASURE_DIGITS) for c in measures})
    return agg.withColumn("cohort_month", month_label(F.col("m0"))).select(*own, *REQUIRED_COLUMNS)
