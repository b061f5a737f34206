"""I1-I12 initiative prioritisation: cleaning, single initiative, ROI/payback rules, roadmap."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import portfolio
from cohortlens.operators.value import run_clv_model
from tests.conftest import cohort_df, golden_rows


@pytest.fixture(scope="module")
def base(spark):
    rows = golden_rows(1) + golden_rows(1, market="Brazil", cpm=7.5, households=500, cohort_month="2025-04")
    return run_clv_model(cohort_df(spark, rows), 0.10)


def test_presets_rank_and_classes(base):
    t = portfolio.score_initiatives(base).collect()
    assert [r.rank for r in t] == list(range(1, 9)) or sorted(r.rank for r in t) == list(range(1, 9))
    by = {r.initiative: r for r in t}
    assert by["Reporting Infrastructure / BI Automation"].classification == "Enabler"
    assert by["Onboarding Optimization"].classification == "Quick win"
    assert by["International Lifecycle Optimization"].classification == "Strategic bet"
    assert max(r.balanced_score for r in t) == 100.0 and min(r.balanced_score for r in t) == 0.0


def test_single_initiative_scores_50(spark, base):
    ini = spark.createDataFrame([("Solo", 0.1)], "initiative string, retention_lift double")
    t = portfolio.score_initiatives(base, ini).collect()
    assert len(t) == 1 and t[0].score == 50.0 and t[0].balanced_score == 50.0
    assert t[0].roi == 0.0 and t[0].payback_months is None  # cost defaults to 0
    assert t[0].confidence == 3.0 and t[0].retention_risk == 3.0


def test_cleaning_blank_names_and_nan(spark, base):
    ini = spark.createDataFrame([("  ", 0.1, 1.0), (" Keep ", float("nan"), None), (None, 0.2, 2.0)],
                                "initiative string, cpm_lift double, cost double")
    t = portfolio.score_initiatives(base, ini).collect()
    assert [r.initiative for r in t] == ["Keep"]
    assert t[0].incremental_value == pytest.approx(0.0, abs=1e-9)


def test_roadmap_and_top(base):
    ranked = portfolio.score_initiatives(base)
    rm = portfolio.roadmap(ranked).collect()
    assert {r.bucket for r in rm} <= {"Now", "Next", "Foundational"}
    assert all(r.roi is None for r in rm if r.classification == "Enabler")
    top = portfolio.top_initiative(ranked).first().top_initiative
    assert top == ranked.where(F.col("rank") == 1).first().initiative
    pts = portfolio.impact_complexity(ranked).collect()
    assert all(r.size >= 5.0 for r in pts)


def test_initiatives_in_any_number_of_blocks(spark, base, monkeypatch):
    from cohortlens.operators import scenario

    ini = spark.createDataFrame([(f"i{i % 7}", i / 100.0, float(i)) for i in range(40)],
                                "initiative string, retention_lift double, cost double")
    want = portfolio.score_initiatives(base, ini).orderBy("rank").collect()
    monkeypatch.setattr(scenario, "MAX_SCENARIOS_PER_PASS", 3)
    monkeypatch.setattr(scenario, "BLOCKS_PER_PASS", 4)
    assert portfolio.score_initiatives(base, ini).orderBy("rank").collect() == want and len(want) == 40


def test_scenario_table_equals_scenario_list(spark, base):
    from cohortlens.operators import scenario

    rows = [*scenario.PRESETS, scenario.Scenario("br", {"cpm_lift": 0.2}, 10.0, market="Brazil")]
    got = scenario.compare_scenario_table(base, scenario.scenario_table(spark, rows)).orderBy("scenario_id").collect()
    assert got == scenario.compare_scenarios(base, rows).orderBy("scenario_id").collect() and len(got) == 5
    scoped = scenario.scenario_table(spark, [scenario.Scenario("s", {}, engagement_segment="High")])
    with pytest.raises(Exception, match="engagement_segment"):
        scenario.compare_scenario_table(base, scoped).collect()


def test_empty_portfolio_keeps_its_columns(spark):
    from cohortlens.operators import portfolio
    from cohortlens.plans.baseline import baseline_table
    from tests.conftest import SF_SMALL

    b = baseline_table(spark, SF_SMALL)
    none = portfolio.initiatives_table(spark).limit(0)
    ranked = portfolio.score_initiatives(b, none)
    assert ranked.columns == portfolio.score_initiatives(b).columns and ranked.count() == 0
    assert portfolio.roadmap(ranked).count() == portfolio.impact_complexity(ranked).count() == 0
