"""Operators that must hold for tables, contexts and grids of any size."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import contexts, ranks, terms, value, verify
from cohortlens.plans.baseline import baseline_table
from tests.conftest import SF_SMALL

FACTS = "context_id string, path string, value_double double, value_string string"


def test_ordinal_rank_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice((None, 1.0, 2.0, 7.5)) if i % 3 else 5.0, rng.choice("abc"), i) for i in range(500)]
    df = spark.createDataFrame(rows, "x double, name string, at int").repartition(6)
    order = [F.desc("x"), F.asc("name"), F.asc("at")]
    want = [r.at for r in df.orderBy(*order).collect()]
    for ranges in (None, 1, 7):
        got = ranks.ordinal_rank(df, order, "rank", ranges)
        assert [r.at for r in sorted(got.collect(), key=lambda r: r["rank"])] == want
        assert sorted(r["rank"] for r in got.collect()) == list(range(1, 501))
    assert ranks.ordinal_rank(df.limit(0), order, "rank", 7).count() == 0


def test_no_single_task_holds_the_rows_of_a_ranking(spark):
    """Exchanges into one partition are aggregates of one row, and windows are inside ranges."""
    df = spark.range(1000).withColumn("x", (F.col("id") * 7919) % 1000 / 3.0)
    ranked = ranks.ordinal_rank(ranks.minmax_normalized(df, {"x": "n"}), [F.asc("n"), F.asc("id")], "rank", 9)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Window [row_number() windowspecdefinition(__range" in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            assert "Aggregate" in lines[i + 1] and "partial_" in lines[i + 1]
    values = {r.id: (r.n, r["rank"]) for r in ranked.collect()}
    want = {i: k + 1 for k, i in enumerate(sorted(range(1000), key=lambda i: (i * 7919 % 1000, i)))}
    assert {i: r for i, (_, r) in values.items()} == want
    assert min(n for n, _ in values.values()) == 0.0 and max(n for n, _ in values.values()) == 1.0


def test_ranges_follow_the_rows(spark):
    """A crowded stretch of values gets the ranges that its rows need; no cut is made on the driver."""
    df = spark.range(20_000).select(F.when(F.col("id") < 18_000, 2000 + F.col("id") / 100.0).otherwise(F.exp(F.col("id") / 1000.0)).alias("x"))
    sizes = [r["count"] for r in ranks.with_ranges(df, ["x"], "r", 10).groupBy("r").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 20_000 / 10
    got = ranks.rank_table(df, ["x"], rows_per_bucket=1500)[0]
    assert got.count() == 20_000 and got.agg(F.min("pr"), F.max("pr")).first() == (1 / 20_000, 1.0)


@pytest.mark.parametrize("ranges", [None, 1, 12])
def test_nearest_numbers_in_a_crowded_range(spark, ranges):
    """90 % of the figures of one context lie between 2000 and 2300."""
    rng = random.Random(8)
    draw = lambda: rng.uniform(2000, 2300) if rng.random() < 0.9 else rng.choice((0.0, 1e-20, 3.5, 4e9, -2100.25))
    figs = [("a" if rng.random() < 0.8 else "b", draw()) for _ in range(600)] + [("none", 5.0)]
    pool = [("a" if rng.random() < 0.8 else "b", draw()) for _ in range(300)]
    got = verify.nearest_numbers(spark.createDataFrame(figs, "context_id string, value double"), spark.createDataFrame(pool, "context_id string, n double"), ranges)
    seen = {(r.context_id, r.size): (r.below, r.above) for r in got.collect()}
    want = {}
    for c, v in figs:
        known = [abs(n) for k, n in pool if k == c]
        want[c, abs(v)] = (max((n for n in known if n <= abs(v)), default=None), min((n for n in known if n > abs(v)), default=None))
    assert seen == want


def test_nested_contexts(spark):
    rows = [("a", json.dumps({"market": "X1 2,000", "n": 3, "f": 1.5e-7, "b": True, "z": None, "e": {}, "l": [1, [2.5, {"k": "7%"}], []], "baseline_kpis": {"avg": 10},
                              "scenario_kpis": {"avg": 12.5}, "big": 12345678901234567890123.5})),
            ("bad", "{bad"), ("none", None), ("empty", "{}"), ("scalar", "5"), ("f", '[1, {"q": [[[9]]]}]'), ("f", '{"more": -4}')]
    got = {(r.context_id, r.path): (r.value_double, r.value_string) for r in contexts.nested_facts(spark.createDataFrame(rows, "context_id string, context string")).collect()}
    assert got == {
        ("a", "market"): (None, "X1 2,000"), ("a", "n"): (3.0, None), ("a", "f"): (1.5e-7, None), ("a", "b"): (None, "True"), ("a", "z"): (None, None), ("a", "e"): (None, None),
        ("a", "l[0]"): (1.0, None), ("a", "l[1][0]"): (2.5, None), ("a", "l[1][1].k"): (None, "7%"), ("a", "l[2]"): (None, None), ("a", "baseline_kpis.avg"): (10.0, None),
        ("a", "scenario_kpis.avg"): (12.5, None), ("a", "big"): (12345678901234567890123.5, None), ("f", "[0]"): (1.0, None), ("f", "[1].q[0][0][0]"): (9.0, None), ("f", "more"): (-4.0, None)}


def _walked(x):
    if isinstance(x, dict):
        return [n for v in x.values() for n in _walked(v)]
    if isinstance(x, list):
        return [n for v in x for n in _walked(v)]
    return [] if isinstance(x, (bool, str)) or x is None else [float(x)]


def test_nested_contexts_of_random_depth(spark):
    rng = random.Random(4)

    def value_of(depth):
        kind = rng.randrange(7) if depth else rng.randrange(4)
        if kind < 4:
            return (rng.randrange(-10**6, 10**6), rng.random() * 10 ** rng.randrange(-9, 9), "word", rng.choice((True, None)))[kind]
        return [value_of(depth - 1) for _ in range(rng.randrange(4))] if kind < 6 else {f"k{i}": value_of(depth - 1) for i in range(rng.randrange(4))}

    docs = {f"d{i}": {"x": value_of(6), "y": [value_of(5)]} for i in range(60)}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "context_id string, context string")
    got = {}
    for r in contexts.nested_facts(df).where("value_double is not null").collect():
        got.setdefault(r.context_id, []).append(r.value_double)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(_walked(v)) for k, v in docs.items() if _walked(v)}


def test_drafts_against_nested_contexts(spark):
    facts = contexts.nested_facts(spark.createDataFrame([("c", '{"baseline_kpis": {"clv": 10}, "scenario_kpis": {"clv": 12}, "rows": [{"note": "kept 61.5%"}, {"on": true, "v": [[0.25]]}]}'),
                                                         ("e", '{"a": {}}'), ("gone", "{}")], "context_id string, context string"))
    drafts = spark.createDataFrame([("1", "c", "up 20.0% to $12.00, 61.5% kept, 25.0% of all, 9.5x"), ("2", "e", "up 3.5%"), ("3", "gone", "up 3.5%")], "draft_id string, context_id string, text string")
    got = {r.draft_id: (r.total, r.verified, r.unverified) for r in verify.verify_drafts(drafts, facts).collect()}
    assert got == {"1": (5, 4, ["9.5x"]), "2": (1, 0, ["3.5%"]), "3": (0, 0, [])}


def test_grid_equals_the_model_at_each_rate(spark):
    b = baseline_table(spark, SF_SMALL)
    rates, costs = [0.0, 0.1, 0.25], [-2.0, 0.0, 6.5, 500.0]
    got = {(r.market, r.discount_rate, r.acquisition_cost): r for r in terms.terms_grid(b, rates, costs, ["market"]).collect()}
    assert len(got) == b.select("market").distinct().count() * 12
    raw = b.drop(*value.CLV_COLUMNS)
    for rate in rates:
        modelled = value.run_clv_model(raw, rate)
        per_row = value.run_clv_model(raw, F.lit(rate))
        assert per_row.agg(F.sum("discounted_clv")).first()[0] == pytest.approx(modelled.agg(F.sum("discounted_clv")).first()[0], rel=1e-12)
        for cost in costs:
            kpis = {r.market: r for r in value.portfolio_kpis(modelled, ["market"], cost).collect()}
            paid = {r.market: r.payback_month for r in value.payback_month(modelled, cost, rate, ["market"]).collect()}
            for m, k in kpis.items():
                r = got[m, rate, cost]
                assert r.avg_clv == pytest.approx(k.avg_clv, rel=1e-9) and r.payback_month == paid[m] and r.underwater == k.underwater
                assert r.clv_to_cac == (None if k.clv_to_cac is None else pytest.approx(k.clv_to_cac, rel=1e-9))
    plan = terms.terms_grid(b, [0.01 * i for i in range(25)], [float(i) for i in range(40)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert terms.terms_grid(b.limit(0), rates, costs).count() == 0


def test_amounts_beyond_the_decimal(spark):
    from cohortlens.sources import facts

    lines = spark.createDataFrame([(1, 3e12, 4e-7, "N", "O"), (1, 2.5, 0.25, "N", "O"), (2, float("inf"), 0.5, "R", "F"), (2, None, None, "R", "F"), (3, 1e25, 0.1, "R", "F")],
                                  "l_orderkey long, l_quantity double, l_discount double, l_returnflag string, l_linestatus string")
    lines = lines.withColumn("l_extendedprice", F.lit(10.0)).withColumn("l_tax", F.lit(0.125))
    orders = spark.createDataFrame([(1, 7, 5e13, "1-URGENT"), (2, 7, 1.5, "x"), (3, 8, float("nan"), "x"), (4, 9, 2.25, "x")], "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string")
    orders = orders.withColumn("o_orderdate", F.lit("1995-03-01").cast("date"))
    got = {r.custkey: r for r in facts.customer_facts(lines, orders).collect()}
    assert got[7].qty == got[7].qty_m0 == 3e12 + 2.5 and got[7].disc == pytest.approx(0.75 + 4e-7, rel=1e-12) and got[7].sum_total == 5e13 + 1.5
    assert got[8].qty == 1e25 and got[8].sum_total is None and got[7].price == 40.0
    assert got[9].qty == 0.0 and got[9].sum_total == 2.25


def test_orders_of_a_task_are_bounded(spark, monkeypatch):
    """Line items are dealt by order key to as many tasks as their number asks for, before any of them are added up."""
    from cohortlens.sources import facts
    monkeypatch.setattr(facts, "LINES_PER_TASK", 50)
    lines = spark.range(2000).selectExpr("IF(id % 10 = 9, NULL, id % 700) AS l_orderkey", "1D AS l_quantity", "0D AS l_discount", "2D AS l_extendedprice",
                                         "0D AS l_tax", "IF(id % 2 = 0, 'N', 'R') AS l_returnflag", "'O' AS l_linestatus")
    orders = spark.range(720).selectExpr("IF(id = 719, NULL, id) AS o_orderkey", "id % 7 AS o_custkey", "TIMESTAMP'1995-01-01' AS o_orderdate", "1D AS o_totalprice", "'1-URGENT' AS o_orderpriority")
    found = facts.customer_facts(lines, orders)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = next(i for i, x in enumerate(plan) if "hashpartitioning(l_orderkey" in x and ", 40)" in x)
    assert not any("Aggregate" in x for x in plan[dealt:dealt + 3])
    got = found.agg(F.sum("n_ord"), F.sum("n_li"), F.sum("qty"), F.sum("n_flag_n")).first()
    assert tuple(got) == (720, 1800, 1800.0, 1000)


def test_customer_months_of_a_task_are_bounded(spark, monkeypatch):
    """Customer months are dealt to as many tasks as the lines ask for, whatever the session's partitions; a large customer's orders are added up in parts."""
    from cohortlens.sources import facts
    monkeypatch.setattr(facts, "LINES_PER_TASK", 50)
    lines = spark.range(2000).selectExpr("id % 1000 AS l_orderkey", "1D AS l_quantity", "0D AS l_discount", "2D AS l_extendedprice", "0D AS l_tax",
                                         "'N' AS l_returnflag", "'O' AS l_linestatus")
    orders = spark.range(1200).selectExpr("id AS o_orderkey", "IF(id % 3 = 0, 0, id) AS o_custkey", "add_months(DATE'1995-01-01', CAST(id % 2 AS INT)) AS o_orderdate",
                                          "IF(id % 2 = 0, CAST(id AS DOUBLE), NULL) AS o_totalprice", "IF(id % 4 = 0, '1-URGENT', '5-LOW') AS o_orderpriority")
    found = facts.customer_facts(lines, orders)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [x for x in plan if "hashpartitioning(custkey" in x]
    assert len(dealt) == 2 and all(", 40)" in x for x in dealt)
    assert "part#" in dealt[1] and "part#" not in dealt[0]  # by customer, after customer, month and part
    got = {r.custkey: r for r in found.collect()}
    big = got[0]
    assert len(got) == 801 and sum(r.n_ord for r in got.values()) == 1200 and sum(r.n_li for r in got.values()) == 2000
    assert (big.n_ord, big.n_urgent, big.n_li, big.qty, big.price, big.n_li_m0, big.qty_m0) == (400, 100, 668, 668.0, 1336.0, 334, 334.0)
    assert big.sum_total == float(sum(range(0, 1200, 6))) and got[1].sum_total is None and got[1100].qty == 0.0 and got[1100].n_li == 0
