"""DuckDB reference SQL for every registered query (the correctness oracle).

Plain SQL over the pre-registered views ``lineitem orders customer nation region documents``. Floating outputs
are rounded half-even to 6 dp in both engines (distributed sums differ in
the last bits), tercile edges to 9 dp.
"""

from __future__ import annotations

from typing import NamedTuple

# Fixed values, stated here anew so that a wrong constant of the library shows.
RATE = 0.10
CAC = 8.0
CLV_HORIZON_MONTHS = 24
REQUIRED_COLUMNS = [
    "cohort_month", "market", "region", "device_type", "households", "activation_rate", "first_week_hours",
    "first_week_app_installs", "trc_usage_rate", "subscription_conversion_rate", "monthly_streaming_hours",
    "ad_supported_share", "ad_impressions_per_hour", "cpm", "fill_rate", "subscription_arpu", "gross_margin",
    "month_1_retention", "month_3_retention", "month_6_retention", "month_12_retention", "support_cost_per_household"]
RATE_COLUMNS = [
    "activation_rate", "trc_usage_rate", "subscription_conversion_rate", "ad_supported_share", "fill_rate", "gross_margin",
    "month_1_retention", "month_3_retention", "month_6_retention", "month_12_retention"]
NON_NEGATIVE_COLUMNS = ["households", "monthly_streaming_hours", "cpm", "subscription_arpu", "support_cost_per_household",
                        "ad_impressions_per_hour"]


def discount_factors(rate: float) -> list[float]:
    """Month t of 24 at a twelfth of the annual rate."""
    return [1.0 / (1.0 + rate / 12.0) ** t for t in range(1, CLV_HORIZON_MONTHS + 1)]


def r(e: str, d: int = 6) -> str:
    return f"(round_even(CAST({e} AS DOUBLE) * 1e{d}, 0) / 1e{d} + 0.0)"


def dec(x: str, p: int = 38) -> str:
    """The shortest decimal of a double, so that sums are exact and do not vary from run to run."""
    return f"CAST(CAST(({x}) AS VARCHAR) AS DECIMAL({p}, 18))"


def ftot(x: str) -> str:
    return f"CAST(sum({dec(x)}) AS DOUBLE)"


def wsum(x: str, w: str = "households") -> str:
    return f"CAST(sum({dec(x, 27)} * CAST({w} AS DECIMAL(10, 0))) AS DOUBLE)"


def share(part: str, whole: str) -> str:
    return f"{wsum(part)} / greatest({wsum(whole)}, 1e-9)"


def wavg(x: str, w: str = "households") -> str:
    return f"({wsum(x, w)} / nullif(sum({w}), 0))"


# --------------------------------------------------------------- cohorts ----
COHORT_CTES = """
per_order AS (
  SELECT l_orderkey, count(*) AS li_n, sum(l_quantity::DECIMAL(18, 6)) AS li_qty,
         sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS li_flag_n,
         sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS li_status_o,
         sum(l_discount::DECIMAL(18, 6)) AS li_disc, sum(l_extendedprice::DECIMAL(18, 6)) AS li_price,
         sum(l_tax::DECIMAL(18, 6)) AS li_tax
  FROM lineitem GROUP BY l_orderkey),
ol AS (
  SELECT o.o_custkey AS custkey, year(o.o_orderdate) * 12 + month(o.o_orderdate) - 1 AS m,
         o.o_totalprice, CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS urgent,
         coalesce(p.li_n, 0) AS li_n, coalesce(p.li_qty, 0) AS li_qty, coalesce(p.li_flag_n, 0) AS li_flag_n,
         coalesce(p.li_status_o, 0) AS li_status_o, coalesce(p.li_disc, 0) AS li_disc,
         coalesce(p.li_price, 0) AS li_price, coalesce(p.li_tax, 0) AS li_tax
  FROM orders o LEFT JOIN per_order p ON p.l_orderkey = o.o_orderkey),
cm AS (
  SELECT custkey, m, count(*) AS n_ord, sum(urgent) AS n_urgent, sum(o_totalprice::DECIMAL(18, 6)) AS sum_total,
         sum(li_n) AS n_li, sum(li_qty) AS qty, sum(li_flag_n) AS n_flag_n, sum(li_status_o) AS n_status_o,
         sum(li_disc) AS disc, sum(li_price) AS price, sum(li_tax) AS tax
  FROM ol GROUP BY custkey, m),
cmw AS (SELECT *, min(m) OVER (PARTITION BY custkey) AS m0 FROM cm),
cust AS (
  SELECT custkey, min(m0) AS m0, sum(n_ord) AS n_ord, sum(n_urgent) AS n_urgent, sum(sum_total)::DOUBLE AS sum_total,
         sum(n_li) AS n_li, sum(qty)::DOUBLE AS qty, sum(n_flag_n) AS n_flag_n, sum(n_status_o) AS n_status_o,
         sum(disc)::DOUBLE AS disc, sum(price)::DOUBLE AS price, sum(tax)::DOUBLE AS tax,
         sum(CASE WHEN m = m0 THEN qty ELSE 0 END)::DOUBLE AS qty_m0,
         sum(CASE WHEN m = m0 THEN n_li ELSE 0 END) AS n_li_m0,
         max(CASE WHEN m - m0 BETWEEN 1 AND 12 THEN 1 ELSE 0 END) AS ret_1,
         max(CASE WHEN m - m0 BETWEEN 3 AND 14 THEN 1 ELSE 0 END) AS ret_3,
         max(CASE WHEN m - m0 BETWEEN 6 AND 17 THEN 1 ELSE 0 END) AS ret_6,
         max(CASE WHEN m - m0 BETWEEN 12 AND 23 THEN 1 ELSE 0 END) AS ret_12
  FROM cmw GROUP BY custkey),
cohort_raw AS (
  SELECT cust.m0 AS m0, n.n_name AS market, rg.r_name AS region, c.c_mktsegment AS device_type,
         count(*) AS households,
         avg(CAST(CAST(CASE WHEN c.c_acctbal > 0 THEN 1.0 ELSE 0.0 END AS VARCHAR) AS DECIMAL(38, 18)))::DOUBLE AS activation_rate,
         (avg(CAST(CAST(qty_m0 AS VARCHAR) AS DECIMAL(38, 18))) / 10.0)::DOUBLE AS first_week_hours,
         avg(CAST(CAST(CAST(n_li_m0 AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18))) AS first_week_app_installs,
         avg(CAST(CAST(CAST(n_flag_n AS DOUBLE) / nullif(n_li, 0) AS VARCHAR) AS DECIMAL(38, 18))) AS trc_usage_rate,
         avg(CAST(CAST(CAST(n_urgent AS DOUBLE) / nullif(n_ord, 0) AS VARCHAR) AS DECIMAL(38, 18))) AS subscription_conversion_rate,
         (avg(CAST(CAST(qty AS VARCHAR) AS DECIMAL(38, 18))) / 12.0)::DOUBLE AS monthly_streaming_hours,
         avg(CAST(CAST(CAST(n_status_o AS DOUBLE) / nullif(n_li, 0) AS VARCHAR) AS DECIMAL(38, 18))) AS ad_supported_share,
         (16.0 + 100.0 * avg(CAST(CAST(disc / nullif(n_li, 0) AS VARCHAR) AS DECIMAL(38, 18))))::DOUBLE AS ad_impressions_per_hour,
         (avg(CAST(CAST(price / nullif(n_li, 0) AS VARCHAR) AS DECIMAL(38, 18))) / 2000.0)::DOUBLE AS cpm,
         (1.0 - 5.0 * avg(CAST(CAST(tax / nullif(n_li, 0) AS VARCHAR) AS DECIMAL(38, 18))))::DOUBLE AS fill_rate,
         (avg(CAST(CAST(sum_total / nullif(n_ord, 0) AS VARCHAR) AS DECIMAL(38, 18))) / 20000.0)::DOUBLE AS subscription_arpu,
         (0.5 + avg(CAST(CAST(disc / nullif(n_li, 0) AS VARCHAR) AS DECIMAL(38, 18))))::DOUBLE AS gross_margin,
         (0.40 + 0.45 * avg(CAST(CAST(CAST(ret_1 AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18))))::DOUBLE AS month_1_retention,
         (0.30 + 0.45 * avg(CAST(CAST(CAST(ret_3 AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18))))::DOUBLE AS month_3_retention,
         (0.20 + 0.45 * avg(CAST(CAST(CAST(ret_6 AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18))))::DOUBLE AS month_6_retention,
         (0.10 + 0.45 * avg(CAST(CAST(CAST(ret_12 AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18))))::DOUBLE AS month_12_retention,
         (0.2 + 0.005 * avg(CAST(CAST(CAST(n_li AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18))))::DOUBLE AS support_cost_per_household
  FROM cust JOIN customer c ON c.c_custkey = cust.custkey
            JOIN nation n ON n.n_nationkey = c.c_nationkey
            JOIN region rg ON rg.r_regionkey = n.n_regionkey
  GROUP BY cust.m0, n.n_name, rg.r_name, c.c_mktsegment),
cohort AS (
  SELECT lpad(CAST(m0 // 12 AS VARCHAR), 4, '0') || '-' || lpad(CAST(m0 % 12 + 1 AS VARCHAR), 2, '0') AS cohort_month,
         market, region, device_type, households, """ + ", ".join(
    f"round_even({c} * 1e9, 0) / 1e9 + 0.0 AS {c}" for c in REQUIRED_COLUMNS[5:]) + """
  FROM cohort_raw)"""


def _clean_select(src: str) -> str:
    not_null = " AND ".join(
        f"{c} IS NOT NULL" + ("" if c in ("cohort_month", "market", "region", "device_type", "households")
                              else f" AND NOT isnan({c})")
        for c in REQUIRED_COLUMNS)
    cols = []
    for c in REQUIRED_COLUMNS:
        if c in RATE_COLUMNS:
            cols.append(f"least(greatest({c}, 0.0), 1.0) AS {c}")
        elif c == "households":
            cols.append(f"greatest({c}, 0) AS {c}")
        elif c in NON_NEGATIVE_COLUMNS:
            cols.append(f"greatest({c}, 0.0) AS {c}")
        else:
            cols.append(c)
    return f"SELECT {', '.join(cols)} FROM {src} WHERE {not_null}"


def _survival_sql() -> list[str]:
    """S(1..24) from bounded logs l1 l3 l6 l12, bounded b6 b12 and decay."""
    knots = [1, 3, 6, 12]
    logs = {1: "l1", 3: "l3", 6: "l6", 12: "l12"}
    out = []
    for t in range(1, 13):
        lo = max(k for k in knots if k <= t)
        if lo == t:
            e = f"exp({logs[lo]})"
        else:
            hi = knots[knots.index(lo) + 1]
            e = f"exp(({logs[hi]} - {logs[lo]}) / {float(hi - lo)!r} * {float(t - lo)!r} + {logs[lo]})"
        out.append(e)
    for t in range(13, CLV_HORIZON_MONTHS + 1):
        out.append(f"b12 * power(decay, {float(t - 12)!r})")
    return [f"least(greatest({e}, 0.0), 1.0)" for e in out]


def surv_ctes(src: str, name: str) -> str:
    """CTEs adding s1..s24 (survival) to ``src`` as ``name``."""
    s = _survival_sql()
    surv_cols = ", ".join(f"{e} AS s{t + 1}" for t, e in enumerate(s))
    sixth = repr(1.0 / 6.0)
    return f"""
{name}_l AS (
  SELECT *,
    ln(least(greatest(month_1_retention, 1e-4), 1.0)) AS l1,
    ln(least(greatest(month_3_retention, 1e-4), 1.0)) AS l3,
    ln(least(greatest(month_6_retention, 1e-4), 1.0)) AS l6,
    ln(least(greatest(month_12_retention, 1e-4), 1.0)) AS l12,
    least(greatest(month_6_retention, 1e-4), 1.0) AS b6,
    least(greatest(month_12_retention, 1e-4), 1.0) AS b12
  FROM {src}),
{name}_d AS (SELECT *, least(greatest(power(b12 / b6, {sixth}), 0.5), 1.0) AS decay FROM {name}_l),
{name} AS (SELECT * EXCLUDE (l1, l3, l6, l12, b6, b12, decay), {surv_cols} FROM {name}_d)"""


S_COLS = ", ".join(f"s{t}" for t in range(1, CLV_HORIZON_MONTHS + 1))


def clv_ctes(src: str, rate: float = RATE, name: str = "clv") -> str:
    """CTEs computing the CLV columns over ``src`` into ``name``."""
    disc = discount_factors(rate)
    months = " + ".join(f"s{t}" for t in range(1, CLV_HORIZON_MONTHS + 1))
    dsum = " + ".join(f"s{t} * {disc[t - 1]!r}" for t in range(1, CLV_HORIZON_MONTHS + 1))
    return f"""
{name}_in AS (
  SELECT *,
    monthly_streaming_hours * ad_supported_share * ad_impressions_per_hour * fill_rate * cpm / 1000.0 * 0.1
      AS ad_revenue_per_household,
    subscription_conversion_rate * subscription_arpu * 0.2 AS subscription_revenue_per_household
  FROM {src}),{surv_ctes(name + '_in', name + '_t')},
{name}_m AS (
  SELECT * EXCLUDE ({S_COLS}),
    ad_revenue_per_household + subscription_revenue_per_household AS total_monthly_revenue_per_household,
    (ad_revenue_per_household + subscription_revenue_per_household) * gross_margin - support_cost_per_household
      AS gross_profit_per_household,
    {months} AS expected_retained_months,
    {dsum} AS _dsum
  FROM {name}_t),
{name} AS (
  SELECT * EXCLUDE (_dsum),
    gross_profit_per_household * expected_retained_months AS baseline_clv,
    _dsum * gross_profit_per_household AS discounted_clv,
    _dsum * gross_profit_per_household * households AS total_lifecycle_value
  FROM {name}_m)"""


def _pr(x: str) -> str:
    return (f"((CAST(rank() OVER (ORDER BY {x}) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY {x}) AS DOUBLE) - 1.0) / 2.0)"
            f" / CAST(count(*) OVER () AS DOUBLE))")


RANKED = ["first_week_hours", "first_week_app_installs", "trc_usage_rate", "monthly_streaming_hours",
          "revenue_per_household", "monetization_per_streaming_hour", "subscription_conversion_rate",
          "ad_supported_share", "fill_rate", "month_6_retention", "month_12_retention", "month_1_retention",
          "discounted_clv"]


def baseline_ctes(weights=(1.0, 1.0, 1.0, 1.0), src_cohort: str = "cohort", rate: float = RATE) -> str:
    """Full baseline: cohort -> clean -> clv -> ratio metrics -> ranks -> scores -> segment."""
    w = [float(x) for x in weights]
    if len(w) != 4 or sum(w) <= 0:
        w = [1.0, 1.0, 1.0, 1.0]
    total = sum(w)
    eng = " + ".join(f"{wi!r} * p_{c}" for wi, c in zip(w, RANKED[:4]))
    depth = ("0.35 * (100.0 * p_revenue_per_household) + 0.25 * (100.0 * p_monetization_per_streaming_hour)"
             " + 0.2 * (100.0 * p_subscription_conversion_rate) + 0.1 * (100.0 * p_ad_supported_share)"
             " + 0.1 * (100.0 * p_fill_rate)")
    health = ("0.25 * (100.0 * p_month_6_retention) + 0.2 * (100.0 * p_month_12_retention)"
              " + 0.2 * (100.0 * p_monthly_streaming_hours) + 0.15 * (100.0 * p_first_week_hours)"
              " + 0.1 * (100.0 * p_first_week_app_installs) + 0.1 * (100.0 * p_month_1_retention)")
    ranks = ", ".join(f"{_pr(c)} AS p_{c}" for c in RANKED)
    return f"""{COHORT_CTES if src_cohort == 'cohort' else ''}{',' if src_cohort == 'cohort' else ''}
clean AS ({_clean_select(src_cohort)}),
{clv_ctes('clean', rate)},
mon AS (
  SELECT *, total_monthly_revenue_per_household AS revenue_per_household,
    total_monthly_revenue_per_household / greatest(monthly_streaming_hours, 1e-9) AS monetization_per_streaming_hour,
    ad_revenue_per_household / greatest(total_monthly_revenue_per_household, 1e-9) AS ad_revenue_share,
    1.0 - ad_revenue_per_household / greatest(total_monthly_revenue_per_household, 1e-9) AS subscription_revenue_share
  FROM clv),
ranked AS (SELECT *, {ranks} FROM mon),
scored0 AS (
  SELECT *,
    round_even(({eng}) / {total!r} * 1000.0, 0) / 1000.0 + 0.0 AS engagement_score,
    round_even(({depth}) * 10.0, 0) / 10.0 + 0.0 AS monetization_depth_score,
    round_even(({health}) * 10.0, 0) / 10.0 + 0.0 AS experience_health_score
  FROM ranked),
scored AS (
  SELECT *,
    round_even(least(greatest(0.4 * (100.0 * p_discounted_clv) + 0.3 * monetization_depth_score
        + 0.3 * experience_health_score - 15.0 * ((100.0 - 100.0 * p_month_6_retention) / 100.0), 0.0), 100.0)
        * 10.0, 0) / 10.0 + 0.0 AS balanced_value_score,
    {_pr('engagement_score')} AS p_score
  FROM scored0),
edges AS (
  SELECT round_even(quantile_cont(engagement_score, 1.0 / 3.0) * 1e9, 0) / 1e9 + 0.0 AS e1,
         round_even(quantile_cont(engagement_score, 2.0 / 3.0) * 1e9, 0) / 1e9 + 0.0 AS e2,
         round_even(min(engagement_score) * 1e9, 0) / 1e9 + 0.0 AS mn,
         round_even(max(engagement_score) * 1e9, 0) / 1e9 + 0.0 AS mx
  FROM scored),
base AS (
  SELECT s.* EXCLUDE (p_score, {', '.join('p_' + c for c in RANKED)}),
    CASE WHEN e.mn = e.e1 OR e.e1 = e.e2 OR e.e2 = e.mx THEN
           CASE WHEN s.p_score <= 1.0 / 3.0 THEN 'Low' WHEN s.p_score <= 2.0 / 3.0 THEN 'Medium' ELSE 'High' END
         ELSE CASE WHEN s.engagement_score <= e.e1 THEN 'Low' WHEN s.engagement_score <= e.e2 THEN 'Medium'
                   ELSE 'High' END END AS engagement_segment
  FROM scored s CROSS JOIN edges e)"""


def with_base(select: str, weights=(1.0, 1.0, 1.0, 1.0), rate: float = RATE) -> str:
    return f"WITH {baseline_ctes(weights, rate=rate)}\n{select}"


# ----------------------------------------------------------- the queries ----
KEYS = "cohort_month, market, region, device_type"
QUALITY_SPECS = (
    [("missing_values", c, "na") for c in REQUIRED_COLUMNS]
    + [("rate_range", c, "rate") for c in RATE_COLUMNS]
    + [("non_negative", c, "neg") for c in NON_NEGATIVE_COLUMNS]
)


def _is_missing(c: str) -> str:
    if c in ("cohort_month", "market", "region", "device_type", "households"):
        return f"{c} IS NULL"
    return f"({c} IS NULL OR isnan({c}))"


def quality_issues_sql(src: str = "cohort", ctes: str = COHORT_CTES) -> str:
    complete = " AND ".join(f"NOT {_is_missing(c)}" for c in REQUIRED_COLUMNS)
    aggs = ["count(*) AS rows_in", f"sum(CASE WHEN {complete} THEN 1 ELSE 0 END) AS rows_out"]
    for chk, c, kind in QUALITY_SPECS:
        if kind == "na":
            cond = _is_missing(c)
        elif kind == "rate":
            cond = f"{complete} AND ({c} < 0 OR {c} > 1)"
        else:
            cond = f"{complete} AND {c} < 0"
        aggs.append(f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS {kind}__{c}")
    aggs.append(f"sum(CASE WHEN {complete} AND least(greatest(month_12_retention, 0.0), 1.0) > "
                f"least(greatest(month_1_retention, 0.0), 1.0) THEN 1 ELSE 0 END) AS inverted")
    parts = [f"SELECT '{chk}' AS \"check\", '{c}' AS \"column\", CAST({kind}__{c} AS BIGINT) AS n_rows FROM q"
             for chk, c, kind in QUALITY_SPECS]
    parts.append("SELECT 'inverted_retention', 'month_12_retention', CAST(inverted AS BIGINT) FROM q")
    parts.append("SELECT 'rows_remaining', '*', CAST(rows_out AS BIGINT) FROM q")
    parts.append("SELECT 'rows_read', '*', CAST(rows_in AS BIGINT) FROM q")
    return f"WITH {ctes}, q AS (SELECT {', '.join(aggs)} FROM {src})\n" + "\nUNION ALL ".join(parts)


def kpi_select(keys: str = "", src: str = "base", cac: float | None = CAC) -> str:
    k = f"{keys}, " if keys else ""
    avg_clv = wavg("discounted_clv")
    body = (f"SELECT {k}CAST(sum(households) AS BIGINT) AS total_households, {r(avg_clv)} AS avg_clv, "
            f"{r(ftot('total_lifecycle_value'))} AS total_lifecycle_value, "
            f"{r(wavg('month_6_retention'))} AS avg_month_6_retention, "
            f"{r(wavg('total_monthly_revenue_per_household'))} AS avg_revenue_per_household, "
            f"{r(wavg('gross_profit_per_household'))} AS avg_gross_profit_per_household, "
            f"{r(wavg('expected_retained_months'))} AS avg_expected_retained_months, "
            f"{r(share('ad_revenue_per_household', 'total_monthly_revenue_per_household'))}"
            f" AS ad_revenue_share")
    if cac is not None:
        body += (f", {r(repr(float(cac)))} AS acquisition_cost, {r(f'{avg_clv} - {cac!r}')} AS net_clv, "
                 f"{r(f'CASE WHEN {cac!r} > 0 THEN {avg_clv} / {cac!r} END')} AS clv_to_cac, "
                 f"({avg_clv} - {cac!r}) < 0 AS underwater")
    body += f" FROM {src}"
    if keys:
        body += f" GROUP BY {keys}"
    return body + " HAVING sum(households) > 0"


def walkthrough_sql(src: str = "base") -> str:
    steps = [("ad_revenue", wavg("ad_revenue_per_household")),
             ("subscription_revenue", wavg("subscription_revenue_per_household")),
             ("monthly_revenue", wavg("total_monthly_revenue_per_household")),
             ("gross_margin", wavg("gross_margin")),
             ("support_cost", wavg("support_cost_per_household")),
             ("gross_profit", wavg("gross_profit_per_household")),
             ("retained_months", wavg("expected_retained_months")),
             ("lifetime_gross_profit", wavg("baseline_clv")),
             ("discount_rate", repr(RATE)),
             ("gross_clv", wavg("discounted_clv")),
             ("acquisition_cost", repr(CAC)),
             ("net_clv", f"{wavg('discounted_clv')} - {CAC!r}")]
    agg = ", ".join(f"{e} AS {n}" for n, e in steps)
    parts = [f"SELECT {i + 1} AS step, '{n}' AS name, {r(n)} AS value FROM a" for i, (n, _) in enumerate(steps)]
    return with_base(f", a AS (SELECT {agg} FROM {src} HAVING sum(households) > 0)\n" + "\nUNION ALL ".join(parts))


def payback_sql(keys: str = "", cac: float = CAC, rate: float = RATE) -> str:
    disc = discount_factors(rate)
    k = f"{keys}, " if keys else ""
    sums = ", ".join(f"{wsum(f's{t} * {disc[t - 1]!r} * gross_profit_per_household')} AS st{t}"
                     for t in range(1, CLV_HORIZON_MONTHS + 1))
    cum = []
    run = None
    for t in range(1, CLV_HORIZON_MONTHS + 1):
        term = f"(st{t} / nullif(_w, 0))"
        run = term if run is None else f"({run} + {term})"
        cum.append(run)
    cums = ", ".join(f"{e} AS c{t + 1}" for t, e in enumerate(cum))
    first = " ".join(f"WHEN c{t} >= {cac!r} THEN {t}" for t in range(1, CLV_HORIZON_MONTHS + 1))
    pay = (f"CASE WHEN {cac!r} <= 0 THEN 0 WHEN _w = 0 OR c24 IS NULL OR c24 < {cac!r} THEN NULL "
           f"ELSE CASE {first} END END")
    group = f" GROUP BY {keys}" if keys else ""
    return with_base(f""",{surv_ctes('base', 'bs')},
pa AS (SELECT {k}CAST(sum(households) AS BIGINT) AS _w, {sums} FROM bs{group}),
pc AS (SELECT *, {cums} FROM pa)
SELECT {k}_w AS households, CAST({pay} AS INTEGER) AS payback_month, {r('c24')} AS cumulative_discounted_gp_24 FROM pc""", rate=rate)


SUMMARY = [("avg_first_week_hours", "first_week_hours"), ("avg_trc_usage_rate", "trc_usage_rate"),
           ("avg_sub_conversion", "subscription_conversion_rate"), ("avg_month_6_retention", "month_6_retention"),
           ("avg_monthly_revenue", "total_monthly_revenue_per_household"), ("avg_clv", "discounted_clv")]


def summary_cols() -> str:
    return ("CAST(sum(households) AS BIGINT) AS households, "
            + ", ".join(f"{r(wavg(src))} AS {n}" for n, src in SUMMARY)
            + f", {r(ftot('discounted_clv * households'))} AS total_lifecycle_value")


def summary_sql(by: str) -> str:
    return with_base(f"SELECT {by}, {summary_cols()} FROM base GROUP BY {by}")


def summaries_sql(dims) -> str:
    parts = [f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS key, {summary_cols()} FROM base GROUP BY {d}"
             for d in dims]
    return with_base("\n" + "\nUNION ALL ".join(parts))


def value_segments_sql(n: int = 3) -> str:
    inner = f"SELECT market, {summary_cols()}, {wavg('discounted_clv')} AS _o FROM base GROUP BY market"
    return with_base(f""", bm AS ({inner})
SELECT * EXCLUDE (_o), row_number() OVER (ORDER BY _o DESC, market) AS position
FROM (SELECT *, 'top_markets' AS list FROM bm ORDER BY _o DESC, market ASC LIMIT {n})
UNION ALL
SELECT * EXCLUDE (_o), row_number() OVER (ORDER BY _o DESC, market)
FROM (SELECT *, 'bottom_markets' AS list FROM bm ORDER BY _o ASC, market DESC LIMIT {n})""")


MON = [("revenue_per_household", "revenue_per_household"),
       ("monetization_per_streaming_hour", "monetization_per_streaming_hour"),
       ("monetization_depth_score", "monetization_depth_score"),
       ("experience_health_score", "experience_health_score"),
       ("balanced_value_score", "balanced_value_score"),
       ("avg_clv", "discounted_clv"), ("avg_month_6_retention", "month_6_retention")]


def mon_summary_sql(by: str, position: str = "") -> str:
    cols = ", ".join(f"{r(wavg(src))} AS {n}" for n, src in MON) + position
    return with_base(f"SELECT {by}, CAST(sum(households) AS BIGINT) AS households, {cols} FROM base GROUP BY {by}")


SEG_CTE = (", seg AS (SELECT market || ' · ' || device_type AS segment, CAST(sum(households) AS BIGINT) AS households, "
           + ", ".join(f"{wavg(src)} AS {n}" for n, src in MON)
           + " FROM base GROUP BY market || ' · ' || device_type), "
           "segg AS (SELECT *, experience_health_score - monetization_depth_score AS gap FROM seg)")


def guardrail_sql(n: int = 5) -> str:
    cols = "segment, households, " + ", ".join(f"{r(c)} AS {c}" for c, _ in MON) + f", {r('gap')} AS gap"
    rg = "round_even(gap * 10.0, 0) / 10.0 + 0.0"
    rng = "round_even(-gap * 10.0, 0) / 10.0 + 0.0"
    return with_base(f"""{SEG_CTE}
SELECT 'under_monetized' AS list, {cols}, {r('lg')} AS list_gap, row_number() OVER (ORDER BY lg DESC, segment) AS position FROM
  (SELECT *, {rg} AS lg FROM segg WHERE gap > 5 ORDER BY lg DESC, segment ASC LIMIT {n})
UNION ALL
SELECT 'experience_risk', {cols}, {r('lg')}, row_number() OVER (ORDER BY lg DESC, segment) FROM
  (SELECT *, {rng} AS lg FROM segg WHERE gap < -5 ORDER BY lg DESC, segment ASC LIMIT {n})
UNION ALL
SELECT 'best_balanced', {cols}, CAST(NULL AS DOUBLE), row_number() OVER (ORDER BY balanced_value_score DESC, segment) FROM
  (SELECT * FROM segg ORDER BY balanced_value_score DESC, segment ASC LIMIT {n})""")


def monetization_kpis_sql() -> str:
    rg = "round_even(gap * 10.0, 0) / 10.0 + 0.0"
    rng = "round_even(-gap * 10.0, 0) / 10.0 + 0.0"
    return with_base(f"""{SEG_CTE}
SELECT {r(wavg('revenue_per_household'))} AS avg_revenue_per_household,
       {r(wavg('monetization_per_streaming_hour'))} AS avg_monetization_per_hour,
       {r(wavg('monetization_depth_score'))} AS avg_monetization_depth,
       {r(wavg('experience_health_score'))} AS avg_experience_health,
       {r(wavg('balanced_value_score'))} AS avg_balanced_value,
       coalesce((SELECT segment FROM segg WHERE gap > 5 ORDER BY {rg} DESC, segment ASC LIMIT 1), 'None flagged')
         AS top_under_monetized,
       coalesce((SELECT segment FROM segg WHERE gap < -5 ORDER BY {rng} DESC, segment ASC LIMIT 1), 'None flagged')
         AS top_experience_risk
FROM base""")


COHORT_COLS = ", ".join(
    c if c in ("cohort_month", "market", "region", "device_type", "households") else f"{r(c)} AS {c}"
    for c in REQUIRED_COLUMNS)
AUDIT = ["ad_revenue_per_household", "subscription_revenue_per_household", "total_monthly_revenue_per_household",
         "gross_profit_per_household", "expected_retained_months", "baseline_clv", "discounted_clv"]
SURV_LONG = " UNION ALL ".join(
    f"SELECT {KEYS}, {t} AS month, {r(f's{t}')} AS survival FROM sl" for t in range(1, CLV_HORIZON_MONTHS + 1))


def line_ranks_sql() -> str:
    def pr(c: str) -> str:
        return (f"(rank() OVER (ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY {c}) + 1)::DOUBLE / 2)::DOUBLE"
                f" / count(*) OVER () AS {c}_pr")
    columns = ("l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return f"SELECT l_orderkey, l_linenumber, {', '.join(map(pr, columns))} FROM lineitem"


def queries() -> dict[str, str]:
    q = {
        **dict.fromkeys(("line_ranks_broadcast", "line_ranks_bucketed", "line_ranks_shuffled", "line_ranks_long"), line_ranks_sql()),
        "cohort_table": f"WITH {COHORT_CTES} SELECT {COHORT_COLS} FROM cohort",
        "quality_issues": quality_issues_sql(),
        "clv_detail": with_base(f"SELECT {KEYS}, engagement_segment, households, "
                                + ", ".join(f"{r(c, 2)} AS {c}" for c in AUDIT)
                                + f", {r('total_lifecycle_value')} AS total_lifecycle_value FROM base"),
        "survival_long": with_base(f",{surv_ctes('base', 'sl')}\n{SURV_LONG}"),
        "kpis": with_base(kpi_select()),
        "kpis_by_market_device": with_base(kpi_select("market, device_type")),
        "walkthrough": walkthrough_sql(),
        "revenue_mix": with_base(
            f", k AS (SELECT {share('ad_revenue_per_household', 'total_monthly_revenue_per_household')} AS a "
            "FROM base HAVING sum(households) > 0) "
            f"SELECT 'ad_revenue' AS revenue_type, {r('a')} AS share FROM k UNION ALL "
            f"SELECT 'subscription_revenue', {r('1.0 - a')} FROM k"),
        "kpis_other_terms": with_base(kpi_select("market", cac=12.5), rate=0.15),
        "payback_other_terms": payback_sql("device_type", cac=12.5, rate=0.15),
        "engagement_segments_weighted": with_base(f"SELECT {KEYS}, {r('engagement_score')} AS engagement_score, "
                                                  "engagement_segment FROM base", weights=(0.4, 0.3, 0.2, 0.1)),
        "payback": payback_sql(),
        "payback_by_market_device": payback_sql("market, device_type"),
        "engagement_segments": with_base(f"SELECT {KEYS}, {r('engagement_score')} AS engagement_score, "
                                         "engagement_segment FROM base"),
        "segment_summary_segment": summary_sql("engagement_segment"),
        "segment_summary_market": summary_sql("market"),
        "segment_summary_device": summary_sql("device_type"),
        "segment_summary_month": summary_sql("cohort_month"),
        "segment_summary_region": summary_sql("region"),
        "segment_summaries": summaries_sql(["engagement_segment", "market", "device_type", "cohort_month", "region"]),
        "value_segments": value_segments_sql(3),
        "monetization_scores": with_base(
            f"SELECT {KEYS}, " + ", ".join(f"{r(c)} AS {c}" for c in (
                "revenue_per_household", "monetization_per_streaming_hour", "ad_revenue_share",
                "subscription_revenue_share", "monetization_depth_score", "experience_health_score",
                "balanced_value_score")) + " FROM base"),
        "monetization_by_market": mon_summary_sql("market"),
        "monetization_by_device": mon_summary_sql("device_type"),
        "guardrail_segments": guardrail_sql(5),
        "monetization_kpis": monetization_kpis_sql(),
    }
    q.update(views_queries())
    q.update(scenario_queries())
    q.update(initiative_queries())
    q.update(insight_queries())
    q.update(verification_queries())
    q.update(extra_queries())
    q.update(third_round_queries())
    q["document_verification_stream"] = q["document_verification"]  # the stream must equal the batch job
    return q


# ------------------------------------------------------ views & filters ----
def r_(e: str, d: int) -> str:
    """numpy-style rounding to d decimals (no outer 6-dp rounding)."""
    return f"(round_even(CAST({e} AS DOUBLE) * {float(10 ** d)!r}, 0) / {float(10 ** d)!r} + 0.0)"


def fp_mean(x: str) -> str:
    return f"({ftot(x)} / count({x}))"


def quadrant_sql() -> str:
    x, y = "monetization_depth_score", "experience_health_score"
    return (f"CASE WHEN {x} < 50.0 AND {y} >= 50.0 THEN 'engaged_under_monetized' "
            f"WHEN {x} >= 50.0 AND {y} < 50.0 THEN 'monetized_experience_risk' "
            f"WHEN {x} >= 50.0 THEN 'healthy_monetized' ELSE 'low_depth_low_health' END")


def grid_sql(x: str, y: str, nx: float, ny: float) -> str:
    return with_base(
        f"SELECT {r(f'floor({x} * CAST({nx} AS DOUBLE)) / CAST({nx} AS DOUBLE)')} AS x_bin, "
        f"{r(f'floor({y} * CAST({ny} AS DOUBLE)) / CAST({ny} AS DOUBLE)')} AS y_bin, count(*) AS cohort_rows, "
        f"CAST(sum(households) AS BIGINT) AS households, {r(wavg('experience_health_score'))} AS avg_health "
        "FROM base GROUP BY 1, 2")


def views_queries() -> dict[str, str]:
    by_yield = f", row_number() OVER (ORDER BY {wavg('monetization_per_streaming_hour')}, {{}}) AS position"
    m = {1: "month_1_retention", 3: "month_3_retention", 6: "month_6_retention", 12: "month_12_retention"}
    rc = ", ".join(f"{wavg(c)} AS m{k}" for k, c in m.items())
    curves = " UNION ALL ".join(f"SELECT segment, 'Month {k}' AS month_label, {k} AS month, {r(f'm{k}')} AS retention FROM rc"
                                for k in m)
    hl = f"""
, ss AS (SELECT engagement_segment, {wavg('discounted_clv')} AS clv, {wavg('month_6_retention')} AS m6
         FROM base GROUP BY engagement_segment),
ms AS (SELECT market, {wavg('discounted_clv')} AS clv, {ftot('discounted_clv * households')} AS tlv FROM base GROUP BY market),
tp AS (SELECT market, tlv FROM ms ORDER BY clv DESC, market ASC LIMIT 1),
sv AS (SELECT max(CASE WHEN engagement_segment = 'High' THEN clv END) AS ch,
              max(CASE WHEN engagement_segment = 'Low' THEN clv END) AS cl,
              max(CASE WHEN engagement_segment = 'High' THEN m6 END) AS mh,
              max(CASE WHEN engagement_segment = 'Low' THEN m6 END) AS ml FROM ss)
SELECT 'high_vs_low_clv_premium' AS metric, {r('ch / nullif(cl, 0) - 1.0')} AS value, CAST(NULL AS VARCHAR) AS label FROM sv
UNION ALL SELECT 'high_vs_low_m6_gap_pts', {r('(mh - ml) * 100.0')}, CAST(NULL AS VARCHAR) FROM sv
UNION ALL SELECT 'top_market_value_share', {r('tp.tlv / nullif((SELECT sum(tlv) FROM ms), 0)')}, tp.market FROM tp
UNION ALL SELECT 'top_market_lifecycle_value', {r('tp.tlv')}, tp.market FROM tp"""
    walk_cols = ["ad_revenue_per_household", "subscription_revenue_per_household", "total_monthly_revenue_per_household",
                 "gross_margin", "support_cost_per_household", "gross_profit_per_household", "expected_retained_months",
                 "baseline_clv", "discounted_clv"]
    return {
        "coverage": with_base(
            "SELECT market, region, count(DISTINCT cohort_month) AS cohorts, CAST(sum(households) AS BIGINT) AS households, "
            f"{r(r_(fp_mean('month_6_retention'), 2))} AS avg_m6_retention_unweighted, "
            f"{r(r_(fp_mean('discounted_clv'), 2))} AS avg_clv_unweighted FROM base GROUP BY market, region"),
        "cardinalities": with_base(
            "SELECT count(*) AS cohort_rows, count(DISTINCT market) AS markets, count(DISTINCT cohort_month) AS "
            "cohort_months, count(DISTINCT device_type) AS device_types FROM base"),
        "retention_curves": with_base(f", rc AS (SELECT engagement_segment AS segment, {rc} FROM base "
                                      f"GROUP BY engagement_segment)\n{curves}"),
        "headline_gaps": with_base(hl),
        "score_grid": with_base(
            "SELECT floor(monetization_depth_score / 5.0) * 5.0 AS depth_bin, "
            "floor(experience_health_score / 5.0) * 5.0 AS health_bin, "
            f"{quadrant_sql()} AS quadrant, count(*) AS cohort_rows, CAST(sum(households) AS BIGINT) AS households, "
            f"{r(wavg('discounted_clv'))} AS avg_clv FROM base GROUP BY 1, 2, 3"),
        "engagement_clv_grid": grid_sql("engagement_score", "discounted_clv", 20.0, 0.2),
        "depth_clv_grid": grid_sql("monetization_depth_score", "discounted_clv", 0.2, 0.2),
        "filtered_kpis_markets": with_base(kpi_select(
            src="(SELECT * FROM base WHERE market IN ('NATION_1', 'NATION_3', 'NATION_7', 'NATION_12') "
                "AND device_type IN ('BUILDING', 'MACHINERY') AND cohort_month IN ('1995-01', '1995-02', '1995-04'))")),
        "walkthrough_scope": walkthrough_sql(
            "(SELECT * FROM base WHERE market = 'NATION_3' AND device_type = 'BUILDING')"),
        "score_points": with_base(
            "SELECT cohort_month, market, device_type, engagement_segment, households, "
            + ", ".join(f"{r(c)} AS {c}" for c in ("engagement_score", "discounted_clv", "monetization_depth_score",
                                                   "experience_health_score"))
            + f", {quadrant_sql()} AS quadrant FROM base"),
        "yield_by_market": mon_summary_sql("market", by_yield.format("market")),
        "yield_by_device": mon_summary_sql("device_type", by_yield.format("device_type")),
        "clv_by_cohort": with_base(
            f"SELECT cohort_month, {summary_cols()}, row_number() OVER (ORDER BY cohort_month) AS position FROM base GROUP BY cohort_month"),
        "filtered_kpis": with_base(kpi_select(src="(SELECT * FROM base WHERE region IN ('AMERICA', 'EUROPE') "
                                                  "AND engagement_segment IN ('High', 'Medium'))")),
        "scoped_walkthrough": with_base(
            "SELECT market, device_type, " + ", ".join(f"{r(wavg(c))} AS {c}" for c in walk_cols)
            + f", {r(wavg('discounted_clv') + ' - 8.0')} AS net_clv FROM base GROUP BY market, device_type"),
    }


# ------------------------------------------------------------- scenarios ----
LEVERS = ["first_week_lift", "app_install_lift", "trc_usage_lift", "sub_conversion_lift", "retention_lift",
          "cpm_lift", "gross_margin_change", "experience_risk_penalty"]


class What(NamedTuple):
    scenario_id: str
    levers: dict
    cost: float | None = None
    market: str | None = None
    device_type: str | None = None
    engagement_segment: str | None = None


# The preset scenarios.
PRESETS = [
    What("onboarding_push", {"first_week_lift": 0.15, "app_install_lift": 0.10}, 750_000.0),
    What("engagement_push", {"trc_usage_lift": 0.20}, 900_000.0),
    What("monetization_push", {"cpm_lift": 0.10, "sub_conversion_lift": 0.15}, 600_000.0),
    What("reset_to_baseline", {}, 0.0),
]


# The scoped scenarios and the verdict grid of the queries.
SCOPED = [
    What("cpm20_risk30_all", {"cpm_lift": 0.20, "experience_risk_penalty": 0.30}),
    What("monetization_push_nation3_high", {"cpm_lift": 0.10, "sub_conversion_lift": 0.15}, 600_000.0, "NATION_3", None, "High"),
    What("onboarding_building", {"first_week_lift": 0.15, "app_install_lift": 0.10}, 750_000.0, None, "BUILDING"),
    What("retention_margin_nation7_machinery_low", {"retention_lift": 0.10, "gross_margin_change": -0.02}, 250_000.0, "NATION_7",
         "MACHINERY", "Low"),
    What("trc_push_low", {"trc_usage_lift": 0.30, "experience_risk_penalty": 0.5}, 400_000.0, None, None, "Low"),
    What("empty_scope", {"retention_lift": 0.05}, 100_000.0, "NO_SUCH_MARKET"),
]
GRID = [What(f"cpm{cpm}_risk{risk}_sub{lift}", {"cpm_lift": cpm, "experience_risk_penalty": risk, "sub_conversion_lift": lift}, 500_000.0)
        for cpm in (0.0, 0.1, 0.2, 0.35, 0.5) for risk in (0.0, 0.3, 0.6, 1.0) for lift in (0.0, 0.15)]
COMPARED = [
    "scenario_id", "initiative_cost", "households", "baseline_avg_clv", "scenario_avg_clv", "baseline_total_lifecycle_value",
    "scenario_total_lifecycle_value", "baseline_avg_month_6_retention", "scenario_avg_month_6_retention",
    "baseline_avg_revenue_per_household", "scenario_avg_revenue_per_household", "baseline_avg_gross_profit_per_household",
    "scenario_avg_gross_profit_per_household", "baseline_avg_expected_retained_months", "scenario_avg_expected_retained_months",
    "baseline_ad_revenue_share", "scenario_ad_revenue_share", "baseline_mph", "scenario_mph", "baseline_hours", "scenario_hours",
    "incremental_value", "incremental_clv_per_household", "clv_lift_pct", "roi", "payback_months", "never_pays_back",
    "month_6_retention_delta_pts", "mph_change_pct", "streaming_hours_change_pct", "verdict"]


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"CAST({float(v)!r} AS DOUBLE)"


def scenario_values(scenarios) -> str:
    rows = []
    for s in scenarios:
        vals = [s.scenario_id] + [float(s.levers.get(n, 0.0) or 0.0) for n in LEVERS] + [s.cost, s.market,
                                                                                       s.device_type,
                                                                                       s.engagement_segment]
        rows.append("(" + ", ".join(_lit(v) for v in vals) + ")")
    cols = ", ".join(["scenario_id"] + LEVERS + ["cost", "scope_market", "scope_device", "scope_segment"])
    return f"sc({cols}) AS (SELECT * FROM (VALUES {', '.join(rows)}) v({cols}))"


def fanout_ctes(src: str = "base", name: str = "sclv") -> str:
    mult = ("(1.0 + sc.retention_lift) * (1.0 + 0.25 * sc.first_week_lift) * (1.0 + 0.15 * sc.app_install_lift)"
            " * (1.0 + 0.2 * sc.trc_usage_lift) * (1.0 - sc.experience_risk_penalty * (sc.cpm_lift + sc.sub_conversion_lift))")
    ret = ", ".join(f"least(greatest(b.{c} * ({mult}), 0.0), 0.98) AS {c}"
                    for c in ("month_1_retention", "month_3_retention", "month_6_retention", "month_12_retention"))
    return f"""
fo AS (
  SELECT sc.scenario_id, sc.cost AS initiative_cost, b.market, b.households,
    b.discounted_clv AS b_clv, b.total_lifecycle_value AS b_tlv, b.month_6_retention AS b_m6,
    b.total_monthly_revenue_per_household AS b_rev, b.gross_profit_per_household AS b_gp,
    b.expected_retained_months AS b_months, b.ad_revenue_per_household AS b_ad,
    b.monthly_streaming_hours AS b_hours, b.first_week_hours AS b_fw,
    b.total_monthly_revenue_per_household / greatest(b.monthly_streaming_hours, 1e-9) AS b_mph,
    b.cohort_month, b.region, b.device_type, b.activation_rate,
    b.first_week_hours * (1.0 + sc.first_week_lift) AS first_week_hours,
    b.first_week_app_installs * (1.0 + sc.app_install_lift) AS first_week_app_installs,
    least(greatest(b.trc_usage_rate * (1.0 + sc.trc_usage_lift), 0.0), 1.0) AS trc_usage_rate,
    least(greatest(b.subscription_conversion_rate * (1.0 + sc.sub_conversion_lift), 0.0), 1.0)
      AS subscription_conversion_rate,
    b.monthly_streaming_hours * (1.0 + 0.4 * sc.trc_usage_lift)
      * greatest(0.0, 1.0 - 0.5 * sc.experience_risk_penalty * sc.cpm_lift) AS monthly_streaming_hours,
    b.ad_supported_share, b.ad_impressions_per_hour, b.cpm * (1.0 + sc.cpm_lift) AS cpm, b.fill_rate,
    b.subscription_arpu, least(greatest(b.gross_margin + sc.gross_margin_change, 0.0), 0.95) AS gross_margin,
    {ret}, b.support_cost_per_household
  FROM {src} b JOIN sc ON (sc.scope_market IS NULL OR b.market = sc.scope_market)
    AND (sc.scope_device IS NULL OR b.device_type = sc.scope_device)
    AND (sc.scope_segment IS NULL OR b.engagement_segment = sc.scope_segment)),{clv_ctes('fo', name=name)}"""


def compare_ctes(scenarios) -> str:
    w = "households"
    pair = [
        f"CAST(sum({w}) AS BIGINT) AS households",
        f"{wavg('b_clv')} AS baseline_avg_clv", f"{wavg('discounted_clv')} AS scenario_avg_clv",
        f"{ftot('b_tlv')} AS baseline_total_lifecycle_value", f"{ftot('total_lifecycle_value')} AS scenario_total_lifecycle_value",
        f"{ftot('total_lifecycle_value - b_tlv')} AS incremental_value",
        f"{wavg('b_m6')} AS baseline_avg_month_6_retention", f"{wavg('month_6_retention')} AS scenario_avg_month_6_retention",
        f"{wavg('b_rev')} AS baseline_avg_revenue_per_household",
        f"{wavg('total_monthly_revenue_per_household')} AS scenario_avg_revenue_per_household",
        f"{wavg('b_gp')} AS baseline_avg_gross_profit_per_household",
        f"{wavg('gross_profit_per_household')} AS scenario_avg_gross_profit_per_household",
        f"{wavg('b_months')} AS baseline_avg_expected_retained_months",
        f"{wavg('expected_retained_months')} AS scenario_avg_expected_retained_months",
        f"{share('b_ad', 'b_rev')} AS baseline_ad_revenue_share",
        f"{share('ad_revenue_per_household', 'total_monthly_revenue_per_household')} AS scenario_ad_revenue_share",
        f"{wavg('b_mph')} AS baseline_mph",
        f"{wavg('total_monthly_revenue_per_household / greatest(monthly_streaming_hours, 1e-9)')} AS scenario_mph",
        f"{wavg('b_hours')} AS baseline_hours", f"{wavg('monthly_streaming_hours')} AS scenario_hours",
        f"{wavg('b_fw')} AS baseline_first_week_hours", f"{wavg('first_week_hours')} AS scenario_first_week_hours",
    ]
    inc = "incremental_value"
    has_cost = "(initiative_cost IS NOT NULL AND initiative_cost > 0)"
    return f""", {scenario_values(scenarios)},{fanout_ctes()},
sagg AS (SELECT scenario_id, initiative_cost, {', '.join(pair)} FROM sclv GROUP BY scenario_id, initiative_cost
         HAVING sum(households) > 0),
cmp0 AS (SELECT *,
    scenario_avg_clv - baseline_avg_clv AS incremental_clv_per_household,
    CASE WHEN baseline_avg_clv <> 0 THEN scenario_avg_clv / baseline_avg_clv - 1.0 ELSE 0.0 END AS clv_lift_pct,
    CASE WHEN {has_cost} THEN {inc} / initiative_cost END AS roi,
    CASE WHEN {has_cost} AND {inc} / 24.0 > 0 THEN initiative_cost / ({inc} / 24.0) END AS payback_months,
    {has_cost} AND {inc} / 24.0 <= 0 AS never_pays_back,
    (scenario_avg_month_6_retention - baseline_avg_month_6_retention) * 100.0 AS month_6_retention_delta_pts,
    CASE WHEN baseline_mph <> 0 THEN scenario_mph / baseline_mph - 1.0 END AS mph_change_pct,
    CASE WHEN baseline_hours <> 0 THEN scenario_hours / baseline_hours - 1.0 ELSE 0.0 END AS streaming_hours_change_pct
  FROM sagg),
cmp AS (SELECT *, CASE WHEN incremental_value > 0 AND month_6_retention_delta_pts >= -0.5 THEN 'Balanced'
                       WHEN incremental_value > 0 THEN 'Guardrail flag'
                       WHEN scenario_mph > baseline_mph * 1.001 THEN 'Net negative' ELSE 'Neutral' END AS verdict
        FROM cmp0)"""


def cols_sql(cols, keep=("scenario_id", "households", "never_pays_back", "verdict", "initiative", "classification",
                         "rank", "market", "segment", "best_market", "worst_market", "largest_total_market")) -> str:
    return ", ".join(c if c in keep else f"{r(c)} AS {c}" for c in cols)


def scenario_queries() -> dict[str, str]:
    impact_metrics = [("Avg CLV ($)", "avg_clv"), ("Revenue / HH / mo ($)", "avg_revenue_per_household"),
                      ("Gross profit / HH / mo ($)", "avg_gross_profit_per_household"),
                      ("Retained months", "avg_expected_retained_months")]
    lever_labels = ["first-week engagement", "onboarding app installs", "free-channel usage", "subscription conversion",
                    "retention (direct)", "CPM", "gross margin (pts)", "experience risk penalty"]

    impact = " UNION ALL ".join(
        f"SELECT scenario_id, {i + 1} AS position, '{label}' AS metric, {r('baseline_' + k)} AS baseline, "
        f"{r('scenario_' + k)} AS scenario FROM cmp" for i, (label, k) in enumerate(impact_metrics))
    labels = ", ".join(f"('{k}', {i + 1}, '{v}')" for i, (k, v) in enumerate(zip(LEVERS, lever_labels)))
    levers = f"""
, lv AS (UNPIVOT sc ON {', '.join(LEVERS)} INTO NAME lever VALUE value),
lab(lever, position, label) AS (SELECT * FROM (VALUES {labels}) t(lever, position, label))
SELECT lv.scenario_id, lab.position, lv.lever, lab.label, {r('lv.value')} AS value, {r('cmp.incremental_value')}
  AS incremental_value
FROM lv JOIN lab ON lab.lever = lv.lever JOIN cmp ON cmp.scenario_id = lv.scenario_id WHERE lv.value <> 0"""
    verdict_cols = ["scenario_id", "households", "incremental_value", "month_6_retention_delta_pts", "baseline_mph",
                    "scenario_mph", "roi", "payback_months", "never_pays_back", "verdict"]
    return {
        "scenario_presets": with_base(compare_ctes(PRESETS) + f"\nSELECT {cols_sql(COMPARED)} FROM cmp"),
        "scenario_scoped": with_base(compare_ctes(SCOPED) + f"\nSELECT {cols_sql(COMPARED)} FROM cmp"),
        "scenario_verdicts": with_base(compare_ctes(GRID) + f"\nSELECT {cols_sql(verdict_cols)} FROM cmp"),
        "scenario_impact": with_base(compare_ctes(PRESETS) + "\n" + impact),
        "scenario_levers": with_base(compare_ctes(PRESETS) + levers),
    }


# ----------------------------------------------------------- initiatives ----
QUAL = ["confidence", "speed", "complexity", "strategic_fit", "risk", "retention_risk"]
LIFTS = ["first_week_lift", "app_install_lift", "trc_usage_lift", "sub_conversion_lift", "retention_lift", "cpm_lift"]


# The preset initiatives - lifts, cost and qualities in the order above (no query returns a thesis).
INITIATIVES = [
    ("Onboarding Optimization", 0.15, 0.10, 0, 0, 0, 0, 750_000, 4, 4, 2, 5, 2, 1),
    ("Home Screen Discovery Personalization", 0.08, 0, 0.10, 0, 0.02, 0, 1_500_000, 3, 3, 4, 5, 3, 2),
    ("Roku Channel-Style Engagement Push", 0, 0, 0.20, 0, 0, 0, 900_000, 4, 4, 2, 4, 2, 2),
    ("Subscription Merchandising", 0, 0, 0, 0.18, 0, 0, 600_000, 4, 5, 2, 4, 2, 3),
    ("Ad Monetization Optimization", 0, 0, 0, 0, 0, 0.12, 800_000, 4, 4, 3, 4, 3, 4),
    ("Win-back / Reactivation Campaign", 0, 0, 0, 0, 0.05, 0, 1_100_000, 3, 3, 3, 3, 3, 2),
    ("International Lifecycle Optimization", 0.10, 0, 0, 0, 0.03, 0.08, 2_000_000, 2, 2, 4, 4, 4, 3),
    ("Reporting Infrastructure / BI Automation", 0, 0, 0, 0, 0, 0, 500_000, 5, 3, 3, 4, 1, 1),
]


def initiative_src_presets() -> str:
    rows = ["(" + ", ".join([str(i + 1), *map(_lit, p), "''"]) + ")" for i, p in enumerate(INITIATIVES)]
    cols = ", ".join(["position", "initiative"] + LIFTS + ["cost"] + QUAL + ["thesis"])
    return f"ini AS (SELECT * FROM (VALUES {', '.join(rows)}) v({cols}))"


def initiative_src_csv(path: str) -> str:
    def num(c, d):
        return (f"CASE WHEN TRY_CAST(nullif(trim(\"{c}\"), '') AS DOUBLE) IS NULL OR "
                f"isnan(TRY_CAST(nullif(trim(\"{c}\"), '') AS DOUBLE)) THEN {d} "
                f"ELSE TRY_CAST(nullif(trim(\"{c}\"), '') AS DOUBLE) END")
    cols = [f"{num(c, '0.0')} AS {c}" for c in LIFTS + ["cost"]]
    cols += [f"{num(c, '3.0')} AS {c}" for c in QUAL[:-1]] + ["3.0 AS retention_risk"]
    return (f"ini_raw AS (SELECT *, row_number() OVER () AS position FROM read_csv('{path}', header = true, "
            f"all_varchar = true)), "
            f"ini AS (SELECT position, trim(coalesce(initiative, '')) AS initiative, {', '.join(cols)}, "
            f"coalesce(thesis, '') AS thesis FROM ini_raw WHERE trim(coalesce(initiative, '')) <> '')")


def _n(c: str) -> str:
    lo, hi = f"min({c}) OVER ()", f"max({c}) OVER ()"
    return f"CASE WHEN {hi} - {lo} < 1e-12 THEN 0.5 ELSE ({c} - {lo}) / ({hi} - {lo}) END"


def ranking_ctes(ini_cte: str) -> str:
    """Ranked initiatives as CTE ``iranked``; reuses the scenario fan-out with sc built from ``ini``."""
    zero = "CAST(0.0 AS DOUBLE)"
    sc = (f"sc AS (SELECT 'i' || lpad(CAST(position AS VARCHAR), 5, '0') AS scenario_id, "
          + ", ".join(LIFTS) + f", {zero} AS gross_margin_change, {zero} AS experience_risk_penalty, "
          "CASE WHEN cost > 0 THEN cost END AS cost, CAST(NULL AS VARCHAR) AS scope_market, "
          "CAST(NULL AS VARCHAR) AS scope_device, CAST(NULL AS VARCHAR) AS scope_segment FROM ini)")
    cmp = compare_ctes([])  # body reused below with our own sc
    cmp = cmp[cmp.index("\nfo AS ("):]

    def rel(s, b):
        return f"CASE WHEN {b} <> 0 THEN {s} / {b} - 1.0 ELSE 0.0 END"

    legacy = ("0.3 * n_incremental_value + 0.15 * n_clv_lift_pct + 0.15 * n_roi + 0.1 * (confidence / 5.0)"
              " + 0.1 * (speed / 5.0) + 0.1 * (strategic_fit / 5.0) - 0.1 * (complexity / 5.0) - 0.1 * (risk / 5.0)")
    bal = ("0.25 * n_monetization_lift + 0.2 * n_incremental_value + 0.15 * n_experience_impact"
           " + 0.1 * (confidence / 5.0) + 0.1 * (strategic_fit / 5.0) + 0.05 * (speed / 5.0)"
           " - 0.1 * (complexity / 5.0) - 0.15 * (retention_risk / 5.0)")
    return f""", {ini_cte}, {sc},{cmp},
t0 AS (
  SELECT ini.position, ini.initiative, ini.thesis, ini.cost, {', '.join('ini.' + q for q in QUAL)},
    cmp.incremental_value, cmp.clv_lift_pct,
    {rel('cmp.scenario_avg_revenue_per_household', 'cmp.baseline_avg_revenue_per_household')} AS monetization_lift,
    0.5 * ({rel('cmp.scenario_avg_month_6_retention', 'cmp.baseline_avg_month_6_retention')})
      + 0.3 * ({rel('cmp.scenario_hours', 'cmp.baseline_hours')})
      + 0.2 * ({rel('cmp.scenario_first_week_hours', 'cmp.baseline_first_week_hours')}) AS experience_impact,
    coalesce(cmp.roi, 0.0) AS roi, cmp.payback_months, cmp.never_pays_back
  FROM ini JOIN cmp ON cmp.scenario_id = 'i' || lpad(CAST(ini.position AS VARCHAR), 5, '0')),
t1 AS (SELECT *, {_n('incremental_value')} AS n_incremental_value, {_n('clv_lift_pct')} AS n_clv_lift_pct,
              {_n('roi')} AS n_roi, {_n('monetization_lift')} AS n_monetization_lift,
              {_n('experience_impact')} AS n_experience_impact FROM t0),
t2 AS (SELECT *, {legacy} AS _score, {bal} AS _bal FROM t1),
t3 AS (SELECT *, round_even(100.0 * ({_n('_score')}) * 10.0, 0) / 10.0 + 0.0 AS score,
              round_even(100.0 * ({_n('_bal')}) * 10.0, 0) / 10.0 + 0.0 AS balanced_score FROM t2),
iranked AS (
  SELECT *, row_number() OVER (ORDER BY balanced_score DESC, initiative ASC, position ASC) AS rank,
    CASE WHEN monetization_lift < 0.005 AND experience_impact < 0.005 THEN 'Enabler'
         WHEN complexity <= 2.5 THEN 'Quick win' ELSE 'Strategic bet' END AS classification
  FROM t3)"""


RANK_COLS = ["rank", "initiative", "classification", "balanced_score", "score", "monetization_lift",
             "experience_impact", "incremental_value", "clv_lift_pct", "roi", "payback_months", "never_pays_back",
             "cost"] + QUAL


def initiative_queries() -> dict[str, str]:
    import os
    upload = os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests", "fixtures", "initiatives_upload.csv")
    pre = ranking_ctes(initiative_src_presets())
    roadmap = (f"SELECT CASE classification WHEN 'Quick win' THEN 'Now' WHEN 'Strategic bet' THEN 'Next' "
               f"ELSE 'Foundational' END AS bucket, classification, "
               f"row_number() OVER (PARTITION BY classification ORDER BY rank) AS bucket_position, rank, initiative, "
               f"{r('CASE WHEN roi <> 0 THEN incremental_value END')} AS incremental_value, "
               f"{r('CASE WHEN roi <> 0 THEN roi END')} AS roi FROM iranked")
    impact = (f"SELECT initiative, classification, {r('complexity')} AS complexity, "
              f"{r('incremental_value')} AS incremental_value, {r('greatest(score, 5.0)')} AS size, "
              f"rank = 1 AS is_top FROM iranked")
    return {
        "initiative_ranking": with_base(pre + f"\nSELECT {cols_sql(RANK_COLS)} FROM iranked"),
        "initiative_ranking_uploaded": with_base(ranking_ctes(initiative_src_csv(upload))
                                                 + f"\nSELECT {cols_sql(RANK_COLS)} FROM iranked"),
        "roadmap": with_base(pre + "\n" + roadmap),
        "impact_complexity": with_base(pre + "\n" + impact),
    }


# -------------------------------------------------------------- insights ----
def under_monetized_ctes() -> str:
    return f"""
, g1s AS (SELECT market || ' · ' || device_type AS segment, CAST(sum(households) AS BIGINT) AS households,
            {wsum('monetization_per_streaming_hour')} AS s_mph,
            {wavg('monetization_per_streaming_hour')} AS mph, {wavg('monthly_streaming_hours')} AS hours,
            {wavg('experience_health_score')} AS health
          FROM base GROUP BY market || ' · ' || device_type),
g1w AS (SELECT *, sum(s_mph) OVER () / nullif(sum(households) OVER (), 0) AS port_mph,
               median(health) OVER () AS median_health FROM g1s),
g1c AS (SELECT *, (port_mph - mph) * hours * households * 12.0 AS v FROM g1w
        WHERE health >= median_health AND mph < port_mph),
g1 AS (SELECT segment, households, {r_('mph', 3)} AS segment_yield_per_hour,
              {r_('port_mph', 3)} AS portfolio_yield_per_hour, {r_('mph / port_mph - 1.0', 3)} AS yield_gap_pct,
              {r_('health', 1)} AS experience_health, {r_('v * 0.5', 0)} AS annual_value_of_closing_half_gap
       FROM g1c ORDER BY v DESC, segment ASC LIMIT 1)"""


def vintage_ctes() -> str:
    def wm(flag, c):
        return wavg(f"CASE WHEN {flag} THEN {c} END", f"CASE WHEN {flag} THEN households END")

    same = lambda x: f"(({x} >= 0) = (clv_d >= 0))"
    return f"""
, mo AS (SELECT cohort_month, row_number() OVER (ORDER BY cohort_month) AS rn, count(*) OVER () AS n
         FROM (SELECT DISTINCT cohort_month FROM base)),
fl AS (SELECT b.*, mo.rn <= 3 AS is_e, mo.rn > mo.n - 3 AS is_l, mo.n AS n FROM base b JOIN mo USING (cohort_month)),
va AS (SELECT max(n) AS n, {wm('is_e', 'discounted_clv')} AS e_clv, {wm('is_l', 'discounted_clv')} AS l_clv,
              {wm('is_e', 'month_6_retention')} AS e_m6, {wm('is_l', 'month_6_retention')} AS l_m6,
              {wm('is_e', 'total_monthly_revenue_per_household')} AS e_rev,
              {wm('is_l', 'total_monthly_revenue_per_household')} AS l_rev FROM fl),
vb AS (SELECT *, l_clv / e_clv - 1.0 AS clv_d,
              CASE WHEN e_rev <> 0 THEN l_rev / e_rev - 1.0 ELSE 0.0 END AS rev_d,
              CASE WHEN e_m6 <> 0 THEN l_m6 / e_m6 - 1.0 ELSE 0.0 END AS m6_d
       FROM va WHERE n >= 4 AND e_clv <> 0),
g2 AS (SELECT (SELECT min(cohort_month) FROM mo WHERE rn <= 3) || ' – ' || (SELECT max(cohort_month) FROM mo WHERE rn <= 3)
                AS oldest_cohorts,
              (SELECT min(cohort_month) FROM mo WHERE rn > n - 3) || ' – ' || (SELECT max(cohort_month) FROM mo WHERE rn > n - 3)
                AS newest_cohorts,
              {r_('clv_d', 3)} AS clv_delta_pct, {r_('(l_m6 - e_m6) * 100.0', 1)} AS month_6_retention_delta_pts,
              {r_('rev_d', 3)} AS revenue_per_hh_delta_pct,
              CASE WHEN {same('m6_d')} AND {same('rev_d')} THEN
                     CASE WHEN abs(m6_d) >= abs(rev_d) THEN 'retention' ELSE 'monetization' END
                   WHEN {same('m6_d')} THEN 'retention' WHEN {same('rev_d')} THEN 'monetization'
                   ELSE 'cohort mix (market/device composition)' END AS primary_driver
       FROM vb)"""


def marginal_ctes() -> str:
    body = compare_ctes([What("retention_plus_5", {"retention_lift": 0.05})])
    body = body[:body.index(",\nsagg AS (")]
    return body + f""",
g3m AS (SELECT market, CAST(sum(households) AS BIGINT) AS households, {wavg('b_clv')} AS base_clv,
               {wavg('discounted_clv')} AS scen_clv FROM sclv GROUP BY market),
g3v AS (SELECT *, (scen_clv - base_clv) / 5.0 AS value_per_hh_per_pct,
               (scen_clv - base_clv) / 5.0 * households AS total_per_pct FROM g3m),
g3b AS (SELECT market, value_per_hh_per_pct AS v FROM g3v ORDER BY value_per_hh_per_pct DESC, market ASC LIMIT 1),
g3w AS (SELECT market, value_per_hh_per_pct AS v FROM g3v ORDER BY value_per_hh_per_pct ASC, market ASC LIMIT 1),
g3t AS (SELECT market, total_per_pct AS v FROM g3v ORDER BY total_per_pct DESC, market ASC LIMIT 1),
g3 AS (SELECT g3b.market AS best_market, {r_('g3b.v', 2)} AS best_value_per_hh_per_pct_lift,
              g3w.market AS worst_market, {r_('g3w.v', 2)} AS worst_value_per_hh_per_pct_lift,
              CASE WHEN g3w.v <> 0 THEN {r_('g3b.v / g3w.v', 1)} END AS spread_x,
              g3t.market AS largest_total_market, {r_('g3t.v', 0)} AS largest_total_per_pct_lift
       FROM g3b, g3w, g3t WHERE (SELECT count(*) FROM g3v) >= 2)"""


G1_COLS = ["segment", "households", "segment_yield_per_hour", "portfolio_yield_per_hour", "yield_gap_pct",
           "experience_health", "annual_value_of_closing_half_gap"]
G2_COLS = ["oldest_cohorts", "newest_cohorts", "clv_delta_pct", "month_6_retention_delta_pts",
           "revenue_per_hh_delta_pct", "primary_driver"]
G3_COLS = ["best_market", "best_value_per_hh_per_pct_lift", "worst_market", "worst_value_per_hh_per_pct_lift",
           "spread_x", "largest_total_market", "largest_total_per_pct_lift"]
G_STR = {"segment", "oldest_cohorts", "newest_cohorts", "primary_driver", "best_market", "worst_market",
         "largest_total_market"}


def _tidy_sql(src: str, insight: str, cols) -> str:
    parts = []
    for c in cols:
        if c in G_STR:
            parts.append(f"SELECT '{insight}' AS insight, '{c}' AS metric, CAST(NULL AS DOUBLE) AS value_double, "
                         f"{c} AS value_string FROM {src}")
        else:
            parts.append(f"SELECT '{insight}', '{c}', {r(c)}, CAST(NULL AS VARCHAR) FROM {src}")
    return " UNION ALL ".join(parts)


def insight_queries() -> dict[str, str]:
    keep = set(G_STR) | {"households"}
    return {
        "under_monetized": with_base(under_monetized_ctes() + f"\nSELECT {cols_sql(G1_COLS, keep)} FROM g1"),
        "vintage_trend": with_base(vintage_ctes() + f"\nSELECT {cols_sql(G2_COLS, keep)} FROM g2"),
        "marginal_retention": with_base(marginal_ctes() + f"\nSELECT {cols_sql(G3_COLS, keep)} FROM g3"),
        "marginal_retention_by_market": with_base(
            marginal_ctes() + "\nSELECT market, households, " + ", ".join(
                f"{r(c)} AS {c}" for c in ("base_clv", "scen_clv", "value_per_hh_per_pct", "total_per_pct"))
            + " FROM g3v"),
        "gap_insights": with_base(under_monetized_ctes() + vintage_ctes() + marginal_ctes() + "\n"
                                  + " UNION ALL ".join([_tidy_sql("g1", "under_monetized_opportunity", G1_COLS),
                                                        _tidy_sql("g2", "vintage_trend", G2_COLS),
                                                        _tidy_sql("g3", "marginal_retention_value", G3_COLS)])),
    }


# ------------------------------------------------------------- grounding ----
SEG_COLS = ["households", "avg_first_week_hours", "avg_trc_usage_rate", "avg_sub_conversion", "avg_month_6_retention",
            "avg_monthly_revenue", "avg_clv", "total_lifecycle_value"]


def _fact_val(c: str, kind: str, digits) -> tuple[str, str]:
    if kind == "str":
        return "CAST(NULL AS DOUBLE)", c
    if kind == "bool":
        return "CAST(NULL AS DOUBLE)", f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
    if kind == "int" or digits is None:
        return f"CAST({c} AS DOUBLE)", "CAST(NULL AS VARCHAR)"
    return r_(c, digits), "CAST(NULL AS VARCHAR)"


def record_facts_sql(src: str, ctx: str, prefix: str, cols, digits=3) -> str:
    parts = []
    for c, kind in cols:
        vd, vs = _fact_val(c, kind, digits)
        parts.append(f"SELECT '{ctx}' AS context_id, '{prefix}.{c}' AS path, {vd} AS value_double, {vs} AS value_string "
                     f"FROM {src}")
    return " UNION ALL ".join(parts)


def records_facts_sql(src: str, ctx: str, prefix: str, cols, order: str, limit: int = 12, digits=3) -> str:
    inner = f"(SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS __i FROM {src}) q WHERE __i < {limit}"
    parts = []
    for c, kind in cols:
        vd, vs = _fact_val(c, kind, digits)
        parts.append(f"SELECT '{ctx}' AS context_id, '{prefix}[' || CAST(__i AS VARCHAR) || '].{c}' AS path, "
                     f"{vd} AS value_double, {vs} AS value_string FROM {inner}")
    return " UNION ALL ".join(parts)


def seg_summary_cte(name: str, by: str, src: str = "base") -> str:
    return (f"{name} AS (SELECT {by}, CAST(sum(households) AS BIGINT) AS households, "
            + ", ".join(f"{wavg(s_)} AS {n}" for n, s_ in SUMMARY)
            + f", {ftot('discounted_clv * households')} AS total_lifecycle_value FROM {src} GROUP BY {by})")


KPI_COLS = [("total_households", "int"), ("avg_clv", "d"), ("total_lifecycle_value", "d"),
            ("avg_month_6_retention", "d"), ("avg_revenue_per_household", "d"), ("avg_gross_profit_per_household", "d"),
            ("avg_expected_retained_months", "d"), ("ad_revenue_share", "d")]


def kpi_cte(name: str, src: str = "base") -> str:
    return (f"{name} AS (SELECT CAST(sum(households) AS BIGINT) AS total_households, {wavg('discounted_clv')} AS avg_clv, "
            f"{ftot('total_lifecycle_value')} AS total_lifecycle_value, {wavg('month_6_retention')} AS avg_month_6_retention, "
            f"{wavg('total_monthly_revenue_per_household')} AS avg_revenue_per_household, "
            f"{wavg('gross_profit_per_household')} AS avg_gross_profit_per_household, "
            f"{wavg('expected_retained_months')} AS avg_expected_retained_months, "
            f"{share('ad_revenue_per_household', 'total_monthly_revenue_per_household')} AS ad_revenue_share "
            f"FROM {src} HAVING sum(households) > 0)")


def base_facts_sql(ctx: str, src: str = "base") -> tuple[str, str]:
    """(ctes, union select) for N1 on ``src``."""
    p = f"{ctx}_"
    ctes = ", ".join([kpi_cte(p + "k", src), seg_summary_cte(p + "ss", "engagement_segment", src),
                      seg_summary_cte(p + "sm", "market", src), seg_summary_cte(p + "sd", "device_type", src)])
    seg = [("households", "int")] + [(c, "d") for c in SEG_COLS[1:]]
    sel = " UNION ALL ".join([
        record_facts_sql(p + "k", ctx, "portfolio_kpis", KPI_COLS),
        records_facts_sql(p + "ss", ctx, "by_engagement_segment", [("engagement_segment", "str")] + seg,
                          "avg_clv DESC, engagement_segment ASC"),
        records_facts_sql(p + "sm", ctx, "by_market", [("market", "str")] + seg, "avg_clv DESC, market ASC"),
        records_facts_sql(p + "sd", ctx, "by_device_type", [("device_type", "str")] + seg,
                          "avg_clv DESC, device_type ASC"),
    ])
    return ctes, sel


def insight_tidy_cte() -> str:
    keep = set(G_STR) | {"households"}
    del keep
    parts = []
    for src, insight, cols in (("g1", "under_monetized_opportunity", G1_COLS), ("g2", "vintage_trend", G2_COLS),
                               ("g3", "marginal_retention_value", G3_COLS)):
        for c in cols:
            if c in G_STR:
                parts.append(f"SELECT '{insight}' AS insight, '{c}' AS metric, CAST(NULL AS DOUBLE) AS value_double, "
                             f"{c} AS value_string FROM {src}")
            else:
                parts.append(f"SELECT '{insight}', '{c}', CAST({c} AS DOUBLE), CAST(NULL AS VARCHAR) FROM {src}")
    return "gi AS (" + " UNION ALL ".join(parts) + ")"


def insight_facts_sql(ctx: str) -> str:
    return (f"SELECT '{ctx}' AS context_id, 'gap_insights_non_obvious.' || insight || '.' || metric AS path, "
            "value_double, value_string FROM gi")


def overview_facts_ctes() -> str:
    ctes, sel = base_facts_sql("overview")
    return (under_monetized_ctes() + vintage_ctes() + marginal_ctes() + f", {insight_tidy_cte()}, {ctes}, "
            f"facts AS ({sel} UNION ALL {insight_facts_sql('overview')})")


def finalize_facts(src: str) -> str:
    return f"SELECT context_id, path, {r('value_double')} AS value_double, value_string FROM {src}"


def guardrail_facts_sql(ctx: str) -> tuple[str, str]:
    rg = "round_even(gap * 10.0, 0) / 10.0 + 0.0"
    rng = "round_even(-gap * 10.0, 0) / 10.0 + 0.0"
    mk = (f"gk AS (SELECT {wavg('revenue_per_household')} AS avg_revenue_per_household, "
          f"{wavg('monetization_per_streaming_hour')} AS avg_monetization_per_hour, "
          f"{wavg('monetization_depth_score')} AS avg_monetization_depth, "
          f"{wavg('experience_health_score')} AS avg_experience_health, "
          f"{wavg('balanced_value_score')} AS avg_balanced_value, "
          f"coalesce((SELECT segment FROM segg WHERE gap > 5 ORDER BY {rg} DESC, segment ASC LIMIT 1), 'None flagged')"
          " AS top_under_monetized, "
          f"coalesce((SELECT segment FROM segg WHERE gap < -5 ORDER BY {rng} DESC, segment ASC LIMIT 1), 'None flagged')"
          " AS top_experience_risk FROM base)")
    lists = (f"gu AS (SELECT *, {rg} AS opportunity_gap FROM segg WHERE gap > 5 ORDER BY opportunity_gap DESC, segment "
             f"ASC LIMIT 5), gr AS (SELECT *, {rng} AS risk_gap FROM segg WHERE gap < -5 ORDER BY risk_gap DESC, "
             "segment ASC LIMIT 5), gb AS (SELECT * FROM segg ORDER BY balanced_value_score DESC, segment ASC LIMIT 5)")
    kcols = [(c, "d") for c in ("avg_revenue_per_household", "avg_monetization_per_hour", "avg_monetization_depth",
                                "avg_experience_health", "avg_balanced_value")] + [("top_under_monetized", "str"),
                                                                                   ("top_experience_risk", "str")]
    base_cols = [("segment", "str"), ("households", "int")] + [(c, "d") for c, _ in MON]
    sel = " UNION ALL ".join([
        record_facts_sql("gk", ctx, "portfolio_monetization_kpis", kcols),
        records_facts_sql("gu", ctx, "engaged_under_monetized_segments", base_cols + [("opportunity_gap", "d")],
                          "opportunity_gap DESC, segment ASC", 5),
        records_facts_sql("gr", ctx, "monetized_experience_risk_segments", base_cols + [("risk_gap", "d")],
                          "risk_gap DESC, segment ASC", 5),
        records_facts_sql("gb", ctx, "best_balanced_segments", base_cols, "balanced_value_score DESC, segment ASC", 5),
    ])
    return SEG_CTE[2:] + ", " + mk + ", " + lists, sel


def grounding_sql() -> str:
    ov = overview_facts_ctes()
    cv_ctes, cv_sel = base_facts_sql("cohort_view", "cv")
    dr_ctes, dr_sel = base_facts_sql("drivers")
    g_ctes, g_sel = guardrail_facts_sql("guardrails")
    cohort_month = records_facts_sql("cv_sc", "cohort_view", "by_cohort_month",
                                     [("cohort_month", "str"), ("households", "int")] + [(c, "d") for c in SEG_COLS[1:]],
                                     "avg_clv DESC, cohort_month ASC")
    filt = " UNION ALL ".join(
        f"SELECT 'cohort_view' AS context_id, 'active_filters.region[{i}]' AS path, CAST(NULL AS DOUBLE), '{v}'"
        for i, v in enumerate(["AMERICA", "EUROPE"]))
    mix = ("SELECT 'drivers', 'revenue_mix.ad_revenue_share', " + r_("ad_revenue_share", 3)
           + ", CAST(NULL AS VARCHAR) FROM drivers_k UNION ALL SELECT 'drivers', 'revenue_mix.subscription_revenue_share', "
           + r_("1.0 - ad_revenue_share", 3) + ", CAST(NULL AS VARCHAR) FROM drivers_k")
    return with_base(f"""{ov},
cv AS (SELECT * FROM base WHERE region IN ('AMERICA', 'EUROPE')), {cv_ctes}, {seg_summary_cte('cv_sc', 'cohort_month', 'cv')},
{dr_ctes}, {g_ctes},
allf AS ({' UNION ALL '.join(['SELECT * FROM facts', cv_sel, filt, cohort_month, dr_sel, mix, g_sel])})
{finalize_facts('allf')}""")


# ---------------------------------------------------------- verification ----
RE2_FIGURE = (r"\$\s?\d[\d,]*\.?\d*(?:\s?[KkMmBb])?"
              r"|[-+]?\d[\d,]*\.?\d*\s?(?:%|pts?\b)"
              r"|\b\d+\.?\d*\s?x\b"
              r"|\b\d+\.\d+\s?(?:months?|mo)\b"
              r"|\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b"
              r"|\b\d+\.\d+\b")
SUFFIX_THEN_LETTER = r"(\$\s?\d[\d,]*\.?\d*)(\s?[KkMmBb][A-Za-z])"


def figures_ctes(src: str, keys: str) -> str:
    """Extract and parse figures of ``src(keys..., text)`` into ``pf``."""
    strip = lambda e: f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"
    s = strip(f"regexp_replace(regexp_replace({strip('raw')}, '^\\$+', ''), '[,+]', '', 'g')")
    num = strip("regexp_replace(body, '(%|pts?|months?|mo|x)\\s*$', '', 'i')")
    return f"""
fx AS (SELECT {keys}, regexp_extract_all(regexp_replace(coalesce(text, ''), '{SUFFIX_THEN_LETTER}',
         '\\1' || chr(1) || '\\2', 'g'), '{RE2_FIGURE}') AS l FROM {src}),
fr AS (SELECT {keys}, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM fx),
f1 AS (SELECT *, {s} AS s FROM fr),
f2 AS (SELECT *, lower(right(s, 1)) AS last FROM f1),
f3 AS (SELECT *, CASE last WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1.0 END AS mult,
              CASE WHEN last IN ('k', 'm', 'b') THEN left(s, length(s) - 1) ELSE s END AS body FROM f2),
f4 AS (SELECT *, {num} AS num FROM f3),
pf AS (SELECT {keys}, pos, raw, TRY_CAST(num AS DOUBLE) * mult AS value,
              0.5 * pow(10.0, -(CASE WHEN contains(num, '.') THEN length(split_part(num, '.', 2)) ELSE 0 END)) * mult
                AS tol
       FROM f4 WHERE TRY_CAST(num AS DOUBLE) IS NOT NULL)"""


def pool_ctes(facts: str = "facts") -> str:
    return f"""
pl0 AS (SELECT context_id, value_double AS n FROM {facts} WHERE value_double IS NOT NULL
        UNION ALL
        SELECT context_id, TRY_CAST(replace(tok, ',', '') AS DOUBLE) FROM
          (SELECT context_id, unnest(regexp_extract_all(value_string, '-?\\d[\\d,]*\\.?\\d*')) AS tok FROM {facts}
           WHERE value_string IS NOT NULL)),
pl1 AS (SELECT context_id, unnest([n, n * 100.0, n / 100.0, n * 12.0]) AS n FROM pl0 WHERE n IS NOT NULL),
kb AS (SELECT context_id, regexp_extract(path, '^baseline_kpis\\.([^.\\[]+)$', 1) AS k, value_double AS bv FROM {facts}
       WHERE value_double IS NOT NULL AND regexp_extract(path, '^baseline_kpis\\.([^.\\[]+)$', 1) <> ''),
ks AS (SELECT context_id, regexp_extract(path, '^scenario_kpis\\.([^.\\[]+)$', 1) AS k, value_double AS sv FROM {facts}
       WHERE value_double IS NOT NULL AND regexp_extract(path, '^scenario_kpis\\.([^.\\[]+)$', 1) <> ''),
pl2 AS (SELECT context_id, unnest([sv - bv, abs(sv - bv), (sv - bv) * 100.0, abs(sv - bv) * 100.0]) AS n
        FROM kb JOIN ks USING (context_id, k)
        UNION ALL
        SELECT context_id, unnest([(sv / bv - 1.0) * 100.0, abs((sv / bv - 1.0) * 100.0), (sv / bv - 1.0) * 100.0 / 100.0])
        FROM kb JOIN ks USING (context_id, k) WHERE bv <> 0),
pool AS (SELECT DISTINCT context_id, abs(n) AS b FROM (SELECT * FROM pl1 UNION ALL SELECT * FROM pl2)
         WHERE n IS NOT NULL AND NOT isnan(n) AND NOT isinf(n))"""


def verify_sql(drafts_cte: str) -> str:
    """Drafts CTE ``dr(draft_id, context_id, text)``; facts CTE ``facts`` must exist."""
    return f""", {drafts_cte},
drc AS (SELECT * FROM dr WHERE context_id IN (SELECT DISTINCT context_id FROM facts)),{figures_ctes('drc', 'draft_id, context_id')},
{pool_ctes()[1:]},
mt AS (SELECT pf.draft_id, pf.pos, bool_or(p.b IS NOT NULL) AS ok FROM pf LEFT JOIN pool p ON p.context_id = pf.context_id
       AND abs(abs(pf.value) - p.b) <= greatest(pf.tol, 0.001 * greatest(p.b, abs(pf.value)))
       GROUP BY pf.draft_id, pf.pos),
pv AS (SELECT pf.*, mt.ok, CASE WHEN NOT mt.ok THEN row_number() OVER (PARTITION BY pf.draft_id, mt.ok ORDER BY pf.pos)
       END AS urn FROM pf JOIN mt USING (draft_id, pos)),
per AS (SELECT draft_id, count(*) AS total, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS verified,
               string_agg(CASE WHEN NOT ok THEN raw END, ' | ' ORDER BY pos) AS unv,
               count(*) FILTER (WHERE NOT ok) AS n_unv,
               string_agg(CASE WHEN NOT ok AND urn <= 6 THEN '`' || raw || '`' END, ', ' ORDER BY pos) AS shown
        FROM pv GROUP BY draft_id)
SELECT dr.draft_id, dr.context_id, CAST(coalesce(per.total, 0) AS BIGINT) AS total,
       CAST(coalesce(per.verified, 0) AS BIGINT) AS verified, coalesce(per.unv, '') AS unverified,
       CASE WHEN coalesce(per.total, 0) > 0 AND coalesce(per.n_unv, 0) = 0
              THEN printf('all %d figures cited trace to the model outputs', per.total)
            WHEN coalesce(per.n_unv, 0) > 0
              THEN printf('%d of %d figures could not be traced directly to the model outputs: %s', per.n_unv, per.total,
                          per.shown) END AS verdict
FROM dr LEFT JOIN per USING (draft_id)"""


def market_drafts_cte() -> str:
    r2 = lambda e: r_(e, 2)
    r1 = lambda e: r_(e, 1)
    fmt = ("%s: %s households, average CLV $%.2f, month-6 retention %.1f%%, revenue $%.2f per household per month, "
           "lifecycle value $%.1fK and a %.1fx CLV-to-CAC ratio over %.1f months.")
    return (f"{seg_summary_cte('dm', 'market')}, dr AS (SELECT 'market:' || market AS draft_id, 'overview' AS context_id, "
            f"printf('{fmt}', market, format('{{:,}}', households), {r2('avg_clv')}, "
            f"{r1('avg_month_6_retention * 100.0')}, {r2('avg_monthly_revenue')}, {r1('total_lifecycle_value / 1000.0')}, "
            f"{r1('avg_clv / 8.0')}, {r1('avg_first_week_hours')}) AS text FROM dm)")


def verification_queries() -> dict[str, str]:
    doc_figs = (f"WITH {figures_ctes('documents', 'doc_id')[1:]}\n"
                f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, raw, {r('value')} AS value, {r('tol')} AS tol FROM pf")
    return {
        "grounding_facts": grounding_sql(),
        "draft_figures": with_base(", " + market_drafts_cte() + "," + figures_ctes("dr", "draft_id")
                                   + f"\nSELECT draft_id, CAST(pos AS INTEGER) AS pos, raw, {r('value')} AS value, "
                                   f"{r('tol')} AS tol FROM pf"),
        "grounding_facts_planning": planning_sql(),
        "scenario_verification": scenario_verification_sql(),
        "figure_verification": with_base(overview_facts_ctes() + verify_sql(market_drafts_cte())),
        "document_figures": doc_figs,
        "document_verification": with_base(overview_facts_ctes() + verify_sql(
            "dr AS (SELECT CAST(doc_id AS VARCHAR) AS draft_id, 'overview' AS context_id, text FROM documents)")),
    }


# ------------------------------------------------------ planning contexts ----
_CTE_NAMES = r"\b(sc|fo|sclv\w*|sagg|cmp0|cmp|ini|ini_raw|iranked|t0|t1|t2|t3)\b"


def _rename(sql: str, suffix: str) -> str:
    import re
    return re.sub(_CTE_NAMES, lambda m: m.group(1) + suffix, sql)


def scenario_facts_sql(src: str, ctx: str, levers: dict) -> list[str]:
    """Selects of the scenario context ``ctx``; ``src`` is the compared scenario's one row."""
    names = ["total_households", "avg_clv", "total_lifecycle_value", "avg_month_6_retention", "avg_revenue_per_household",
             "avg_gross_profit_per_household", "avg_expected_retained_months", "ad_revenue_share"]

    def kpis(side):
        return ", ".join(("households" if k == "total_households" else f"{side}_{k}") + f" AS {k}" for k in names)

    kcols = [("total_households", "int")] + [(k, "d") for k in names[1:]]
    head = [f"SELECT '{ctx}' AS context_id, 'scenario_scope' AS path, CAST(NULL AS DOUBLE) AS value_double, "
            "'All households' AS value_string"]
    head += [f"SELECT '{ctx}', 'scenario_levers.{k}', CAST({float(v)!r} AS DOUBLE), CAST(NULL AS VARCHAR)"
             for k, v in levers.items()]
    money = (f"(SELECT {r_('incremental_value', 0)} AS incremental_value, {r_('clv_lift_pct', 4)} AS clv_lift_pct, "
             f"roi, payback_months, initiative_cost FROM {src} x)")
    guard = (f"(SELECT {r_('baseline_mph', 4)} AS monetization_per_hour_baseline, "
             f"{r_('scenario_mph', 4)} AS monetization_per_hour_scenario, "
             f"{r_('month_6_retention_delta_pts', 2)} AS month_6_retention_delta_pts, "
             f"{r_('streaming_hours_change_pct', 4)} AS streaming_hours_change_pct FROM {src} x)")
    money_sel = " UNION ALL ".join(
        f"SELECT '{ctx}', '{c}', CAST({c} AS DOUBLE), CAST(NULL AS VARCHAR) FROM {money} m"
        for c in ("incremental_value", "clv_lift_pct", "roi", "payback_months", "initiative_cost"))
    return head + [
        record_facts_sql(f"(SELECT {kpis('baseline')} FROM {src} x) bk", ctx, "baseline_kpis", kcols),
        record_facts_sql(f"(SELECT {kpis('scenario')} FROM {src} x) sk", ctx, "scenario_kpis", kcols),
        money_sel,
        record_facts_sql(f"{guard} g", ctx, "monetization_and_experience_guardrails",
                         [(c, "d") for c in ("monetization_per_hour_baseline", "monetization_per_hour_scenario",
                                             "month_6_retention_delta_pts", "streaming_hours_change_pct")], None)]


def active_scenario_sql(src: str, ctx: str, levers: dict) -> list[str]:
    head = [f"SELECT '{ctx}', 'active_scenario.levers.{k}', CAST({float(v)!r} AS DOUBLE), CAST(NULL AS VARCHAR)"
            for k, v in levers.items()]
    head.append(f"SELECT '{ctx}', 'active_scenario.scope', CAST(NULL AS DOUBLE), 'All households'")
    exprs = {"incremental_value": r_("incremental_value", 0), "clv_lift_pct": r_("clv_lift_pct", 4), "roi": "roi",
             "payback_months": "payback_months"}
    return head + [f"SELECT '{ctx}', 'active_scenario.{c}', CAST({e} AS DOUBLE), CAST(NULL AS VARCHAR) FROM {src} x"
                   for c, e in exprs.items()]


def scenario_verification_sql() -> str:
    facts = [x for s in PRESETS for x in scenario_facts_sql(f"(SELECT * FROM cmp WHERE scenario_id = '{s.scenario_id}')",
                                                            s.scenario_id, s.levers)]
    fmt = ("%s: CLV moves by $%.2f per household (%.1f%%) to $%.2f, revenue by $%.3f per household per month and "
           "lifetime by %.2f to %.1f months, worth $%.1fK in total; support cost falls by 7.77%%.")
    drafts = ("dr AS (SELECT 'scenario:' || scenario_id AS draft_id, scenario_id AS context_id, "
              f"printf('{fmt}', scenario_id, {r_('scenario_avg_clv - baseline_avg_clv', 2)}, {r_('clv_lift_pct * 100.0', 1)}, "
              f"{r_('scenario_avg_clv', 2)}, {r_('scenario_avg_revenue_per_household - baseline_avg_revenue_per_household', 3)}, "
              f"{r_('scenario_avg_expected_retained_months - baseline_avg_expected_retained_months', 2)}, "
              f"{r_('scenario_avg_expected_retained_months', 1)}, {r_('incremental_value / 1000.0', 1)}) AS text FROM cmp)")
    return with_base(compare_ctes(PRESETS) + f",\nfacts AS ({' UNION ALL '.join(facts)})" + verify_sql(drafts))


def planning_sql() -> str:
    onboarding = PRESETS[0]
    ins = under_monetized_ctes() + vintage_ctes() + marginal_ctes() + ", " + insight_tidy_cte()
    scen = _rename(compare_ctes([onboarding]), "_s")
    rank = _rename(ranking_ctes(initiative_src_presets()), "_r")
    memo_ctes, memo_sel = base_facts_sql("memo")

    rk = [("rank", "int"), ("initiative", "str"), ("classification", "str")]
    rank_cols = rk + [(c, "d") for c in ("balanced_score", "monetization_lift", "experience_impact", "retention_risk",
                                         "incremental_value", "clv_lift_pct", "roi", "payback_months", "confidence",
                                         "complexity", "score")]
    memo_cols = rk + [(c, "d") for c in ("incremental_value", "roi", "payback_months", "score", "balanced_score",
                                         "monetization_lift", "experience_impact", "retention_risk")]
    parts = scenario_facts_sql("cmp_s", "scenario", onboarding.levers) + [
        records_facts_sql("iranked_r", "ranking", "ranked_initiatives", rank_cols, "rank ASC", 12),
        memo_sel, insight_facts_sql("memo"),
        records_facts_sql("iranked_r", "memo", "top_initiatives", memo_cols, "rank ASC", 8),
        *active_scenario_sql("cmp_s", "memo", onboarding.levers),
    ]
    return with_base(f"""{ins}{scen}{rank}, {memo_ctes},
allf AS ({' UNION ALL '.join(parts)})
{finalize_facts('allf')}""")



# ------------------------------------------------------------ extra checks ----
def injected_cohort_cte() -> str:
    m = "substr(cohort_month, 6, 2)"
    cols = []
    for c in REQUIRED_COLUMNS:
        if c == "activation_rate":
            cols.append(f"CASE WHEN {m} = '01' THEN CAST(NULL AS DOUBLE) ELSE activation_rate END AS activation_rate")
        elif c == "fill_rate":
            cols.append(f"CASE WHEN {m} = '06' THEN CAST('NaN' AS DOUBLE) ELSE fill_rate END AS fill_rate")
        elif c == "trc_usage_rate":
            cols.append("CASE WHEN device_type = 'BUILDING' THEN trc_usage_rate + 1.0 ELSE trc_usage_rate END "
                        "AS trc_usage_rate")
        elif c == "cpm":
            cols.append("CASE WHEN device_type = 'MACHINERY' AND region = 'ASIA' THEN -cpm ELSE cpm END AS cpm")
        elif c == "month_12_retention":
            cols.append(f"CASE WHEN {m} = '12' THEN month_12_retention + 1.0 ELSE month_12_retention END "
                        "AS month_12_retention")
        elif c == "households":
            cols.append(f"CASE WHEN region = 'AFRICA' AND {m} = '03' THEN -households ELSE households END "
                        "AS households")
        else:
            cols.append(c)
    return f"dirty AS (SELECT {', '.join(cols)} FROM cohort)"


def issue_records_sql(dirty: str) -> str:
    """Issue records of the CTE ``dirty``."""
    counts = quality_issues_sql("dirty", COHORT_CTES + ", " + dirty)
    order = ", ".join(f"('{chk}', '{c}', {i})" for i, (chk, c, _) in enumerate(
        [*QUALITY_SPECS, ("inverted_retention", "month_12_retention", ""), ("rows_remaining", "*", "")]))
    return f"""WITH counts AS ({counts}),
places(p_check, p_column, place) AS (SELECT * FROM (VALUES {order}) v(p_check, p_column, place)),
listed AS (SELECT "check", "column", n_rows, place FROM counts JOIN places ON "check" = p_check AND "column" = p_column
           WHERE ("check" = 'rows_remaining') = (n_rows = 0))
SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS seq,
  CASE WHEN "check" = 'rows_remaining' THEN 'error' ELSE 'warning' END AS severity,
  CASE WHEN "check" = 'rows_remaining' THEN 'empty_result' ELSE "check" END AS "check",
  CASE WHEN "check" <> 'rows_remaining' THEN "column" END AS "column", n_rows,
  CASE "check"
    WHEN 'missing_values' THEN '`' || "column" || '` has ' || n_rows || ' missing value(s); affected rows were dropped.'
    WHEN 'rate_range' THEN '`' || "column" || '` has ' || n_rows || ' value(s) outside [0, 1]; clipped.'
    WHEN 'non_negative' THEN '`' || "column" || '` has ' || n_rows || ' negative value(s); clipped to 0.'
    WHEN 'inverted_retention' THEN n_rows || ' row(s) have month-12 retention above month-1 retention — check the retention curve inputs.'
    ELSE 'No valid rows remain after cleaning.' END AS message
FROM listed"""


def household_sql() -> str:
    """The baseline with a row for each customer."""
    ctes = baseline_ctes().replace("GROUP BY cust.m0,", "GROUP BY cust.custkey, cust.m0,")
    ctes = ctes.replace("  SELECT cust.m0 AS m0,", "  SELECT cust.custkey AS custkey, cust.m0 AS m0,")
    ctes = ctes.replace("  SELECT lpad(", "  SELECT custkey, lpad(").replace("clean AS (SELECT ", "clean AS (SELECT custkey, ")
    scores = ("discounted_clv", "engagement_score", "monetization_depth_score", "experience_health_score", "balanced_value_score")
    return f"WITH {ctes}\nSELECT custkey, {KEYS}, engagement_segment, {', '.join(f'{r(c)} AS {c}' for c in scores)} FROM base"


def extra_queries() -> dict[str, str]:
    ties = baseline_ctes((0.0, 1.0, 0.0, 0.0), src_cohort="cohort_t")
    ties_sql = (f"WITH {COHORT_CTES}, cohort_t AS (SELECT * REPLACE (CAST(floor(first_week_app_installs / 4.0) AS DOUBLE) "
                f"AS first_week_app_installs) FROM cohort), {ties}\n"
                f"SELECT {KEYS}, {r('first_week_app_installs')} AS first_week_app_installs, "
                f"{r('engagement_score')} AS engagement_score, engagement_segment FROM base")
    return {
        "household_scores": household_sql(),
        "quality_issues_injected": quality_issues_sql("dirty", COHORT_CTES + ", " + injected_cohort_cte()),
        "cohort_csv_roundtrip": f"WITH {COHORT_CTES}, clean AS ({_clean_select('cohort')}), {clv_ctes('clean')[1:]}\n"
                                + kpi_select(src="clv"),
        "engagement_segments_ties": ties_sql,
        "cleaned_injected": f"WITH {COHORT_CTES}, {injected_cohort_cte()}, clean AS ({_clean_select('dirty')})\n"
                            f"SELECT {COHORT_COLS} FROM clean",
        "issue_records_injected": issue_records_sql(injected_cohort_cte()),
        "issue_records_empty": issue_records_sql("dirty AS (SELECT * REPLACE (CAST(NULL AS DOUBLE) AS fill_rate) FROM cohort)"),
        "dataset_created_once": f"WITH {COHORT_CTES} SELECT region, count(*) AS cohort_rows, CAST(sum(households) AS BIGINT) AS households "
                                "FROM cohort GROUP BY region",
        "partitioned_results": f"WITH {COHORT_CTES} SELECT {COHORT_COLS} FROM cohort WHERE region = 'ASIA'",
    }


def grid_terms_sql(rates: list[float], costs: list[float], keys: str = "") -> str:
    """Unit economics for every rate and cost, month by month from the undiscounted terms."""
    k = f"{keys}, " if keys else ""
    months = range(1, CLV_HORIZON_MONTHS + 1)
    sums = ", ".join(f"{wsum(f's{t} * gross_profit_per_household')} AS t{t}" for t in months)
    long = " UNION ALL ".join(f"SELECT {k}rate, cost, households, {t} AS month, t{t} / power(1.0 + rate / 12.0, {t}) / households AS stream FROM ge" for t in months)
    return with_base(f""",{surv_ctes('base', 'bs')},
gt AS (SELECT {k}CAST(sum(households) AS BIGINT) AS households, {sums} FROM bs{f' GROUP BY {keys}' if keys else ''} HAVING sum(households) > 0),
ge AS (SELECT * FROM gt, (SELECT unnest({[float(x) for x in rates]}::DOUBLE[]) AS rate), (SELECT unnest({[float(x) for x in costs]}::DOUBLE[]) AS cost)),
gl AS ({long}),
gc AS (SELECT *, sum(stream) OVER (PARTITION BY {k}rate, cost ORDER BY month ROWS UNBOUNDED PRECEDING) AS cum FROM gl),
gf AS (SELECT {k}rate, cost, households, max(CASE WHEN month = 24 THEN cum END) AS clv, min(CASE WHEN cum >= cost THEN month END) AS first FROM gc GROUP BY {k}rate, cost, households)
SELECT {k}{r('rate')} AS discount_rate, {r('cost')} AS acquisition_cost, households, {r('clv')} AS avg_clv, {r('clv - cost')} AS net_clv,
  CASE WHEN cost > 0 THEN {r('clv / cost')} END AS clv_to_cac, clv - cost < 0 AS underwater,
  CAST(CASE WHEN cost <= 0 THEN 0 WHEN clv >= cost THEN first END AS INTEGER) AS payback_month FROM gf""")


ROW_RATE = "(0.05 + CAST(substr(cohort_month, 6, 2) AS INTEGER) / 100.0::DOUBLE)"


def row_rate_ctes() -> str:
    """The cohorts with a lifetime value at a rate of their own as ``rr``, and each month's discounted profit d1..d24."""
    months = range(1, CLV_HORIZON_MONTHS + 1)
    value = " + ".join(f"s{t} * (1.0 / power(1.0 + rate / 12.0, {t}))" for t in months)
    each = ", ".join(f"s{t} * (1.0 / power(1.0 + rate / 12.0, {t})) * gross_profit_per_household AS d{t}" for t in months)
    return f""",{surv_ctes('base', 'bs')},
rs AS (SELECT *, {ROW_RATE} AS rate FROM bs),
rr AS (SELECT * EXCLUDE (discounted_clv, total_lifecycle_value), ({value}) * gross_profit_per_household AS discounted_clv,
  ({value}) * gross_profit_per_household * households AS total_lifecycle_value, {each} FROM rs)"""


def payback_row_rates_sql() -> str:
    months = range(1, CLV_HORIZON_MONTHS + 1)
    sums = ", ".join(f"{wsum(f'd{t}')} / nullif(sum(households), 0) AS st{t}" for t in months)
    cums = ", ".join(" + ".join(f"st{i}" for i in range(1, t + 1)) + f" AS c{t}" for t in months)
    first = " ".join(f"WHEN c{t} >= {CAC!r} THEN {t}" for t in months)
    clv = wavg("discounted_clv")
    return with_base(row_rate_ctes() + f""",
ra AS (SELECT market, CAST(sum(households) AS BIGINT) AS households, {clv} AS avg_clv, {sums} FROM rr GROUP BY market HAVING sum(households) > 0),
rc AS (SELECT *, {cums} FROM ra)
SELECT market, households, CAST(CASE {first} END AS INTEGER) AS payback_month, {r('c24')} AS cumulative_discounted_gp_24, {r('avg_clv')} AS avg_clv,
  {r(f'avg_clv - {CAC!r}')} AS net_clv, avg_clv - {CAC!r} < 0 AS underwater FROM rc""")


def edited_initiatives_src() -> str:
    """The presets after the changes: one with a new lift and cost, one with another lift and complexity, one gone, one new."""
    rows = [p for p in INITIATIVES if p[0] != "Win-back / Reactivation Campaign"]
    rows = [(p[0], 0.30, *p[2:7], 900_000.0, *p[8:]) if p[0] == "Onboarding Optimization" else p for p in rows]
    rows = [(*p[:6], 0.2, *p[7:10], 5.0, *p[11:]) if p[0] == "Ad Monetization Optimization" else p for p in rows]
    rows.append(("Partner Bundles", 0.05, 0, 0, 0, 0, 0.04, 0.0, 3, 3, 1.0, 3, 3, 3))
    values = ["(" + ", ".join([str(i + 1), *map(_lit, p), "''"]) + ")" for i, p in enumerate(rows)]
    cols = ", ".join(["position", "initiative"] + LIFTS + ["cost"] + QUAL + ["thesis"])
    return f"ini AS (SELECT * FROM (VALUES {', '.join(values)}) v({cols}))"


def nested_contexts_sql() -> str:
    three = lambda e: r_(e, 3)
    dd = seg_summary_cte("dd", "market, device_type")
    number = lambda path, e, src="dm": f"SELECT 'market:' || market AS context_id, '{path}' AS path, CAST({e} AS DOUBLE) AS value_double, CAST(NULL AS VARCHAR) AS value_string FROM {src}"
    words = lambda path, e, src: f"SELECT 'market:' || market, '{path}', NULL, {e} FROM {src}"
    note = f"printf('kept %.1f%% over %s households', {r_('avg_month_6_retention * 100.0', 1)}, format('{{:,}}', households))"
    facts = [number("summary.households", "households"), number("summary.avg_clv", three("avg_clv")), number("summary.rates.month_6", three("avg_month_6_retention")),
             number("summary.rates.revenue", three("avg_monthly_revenue")), number("baseline_kpis.avg_clv", three("avg_clv")),
             number("scenario_kpis.avg_clv", three("avg_clv * 1.1")), number("devices.clv", three("avg_clv"), "dd"),
             number("devices.hours", three("avg_first_week_hours"), "dd"), words("market", "market", "dm"),
             words("devices.note", note, "dd"), words("devices.device_type", "device_type", "dd")]
    drafts = market_drafts_cte()
    cut = drafts.index(", dr AS (")
    own = drafts[cut + 2:].replace("'overview' AS context_id", "'market:' || market AS context_id")
    return with_base(f", {drafts[:cut]}, {dd}, facts AS ({' UNION ALL '.join(facts)})" + verify_sql(own))


def exact_totals_sql() -> str:
    """The amounts alone, in cents: what stands beside them cancels, and the mean of the small ones is their mean."""
    cents = "l_extendedprice::DECIMAL(18, 2)"
    weighted = f"sum({cents} * l_linenumber::DECIMAL(10, 0))"
    return (f"SELECT l_returnflag, l_linestatus, {r(f'sum({cents})::DOUBLE')} AS amount, {r(f'{weighted}::DOUBLE')} AS by_number, "
            f"{r(f'{weighted}::DOUBLE / sum(l_linenumber)')} AS tiny_mean FROM lineitem GROUP BY 1, 2")


def third_round_queries() -> dict[str, str]:
    by_region = "SELECT region, count(*) AS cohort_rows, CAST(sum({h}) AS BIGINT) AS households FROM cohort GROUP BY region"
    ranked = "SELECT " + ", ".join(c if c in ("rank", "initiative", "classification", "never_pays_back") else f"{r(c)} AS {c}" for c in RANK_COLS) + " FROM iranked"
    return {
        "unit_economics_grid": grid_terms_sql([round(0.01 * i, 2) for i in range(25)], [0.5 * i for i in range(40)]),
        "unit_economics_grid_by_market": grid_terms_sql([0.0, 0.08, 0.3], [-1.0, 0.0, 6.25, 1000.0], "market"),
        "clv_row_rates": with_base(row_rate_ctes() + f"\nSELECT {KEYS}, {r('discounted_clv')} AS discounted_clv, {r('total_lifecycle_value')} AS total_lifecycle_value FROM rr"),
        "payback_row_rates": payback_row_rates_sql(),
        "exact_totals": exact_totals_sql(),
        "exact_weighted_means": with_base("SELECT market, " + ", ".join(f"{r(wavg(c))} AS {c}" for c in (
            "month_1_retention", "month_12_retention", "gross_margin", "total_monthly_revenue_per_household", "discounted_clv"))
            + " FROM base GROUP BY market"),
        "dataset_rebuilt": f"WITH {COHORT_CTES} {by_region.format(h='households')}",
        "partitions_replaced": f"WITH {COHORT_CTES} " + by_region.format(h="CASE WHEN region IN ('ASIA', 'EUROPE') THEN 2 ELSE 1 END * households"),
        "cohort_csv_rejected": f"WITH {COHORT_CTES} SELECT CASE region WHEN 'AFRICA' THEN '{len(REQUIRED_COLUMNS) + 2} cells, {len(REQUIRED_COLUMNS)} columns' "
                               "WHEN 'EUROPE' THEN 'incomplete' ELSE 'complete' END AS outcome, count(*) AS n_rows FROM cohort GROUP BY 1",
        "initiative_ranking_edited": with_base(ranking_ctes(edited_initiatives_src()) + "\n" + ranked),
        "nested_context_verification": nested_contexts_sql(),
    }
