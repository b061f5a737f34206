"""V1-V7 validation: one-pass counts, null vs NaN, clips, inverted retention, blocking errors."""


from cohortlens.operators.quality import validate
from cohortlens.schema import REQUIRED_COLUMNS
from tests.conftest import cohort_df, golden_rows


def test_missing_columns_error_in_required_order(spark):
    df = cohort_df(spark, golden_rows()).drop("cpm", "market")
    v = validate(df)
    assert v.errors == ["Missing required columns: market, cpm"]
    assert v.clean is df


def test_counts_drop_and_clip(spark):
    rows = golden_rows(6)
    rows[0]["activation_rate"] = None
    rows[1]["fill_rate"] = float("nan")
    rows[2]["trc_usage_rate"] = 1.2
    rows[3]["gross_margin"] = -0.1
    rows[4]["cpm"] = -3.0
    rows[4]["households"] = -5
    rows[5]["month_12_retention"] = 0.9
    rows[5]["month_1_retention"] = 0.5
    v = validate(cohort_df(spark, rows))
    assert v.rows_in == 6 and v.rows_out == 4
    issues = {(r.check, r.column): r.n_rows for r in v.issues.collect()}
    assert issues[("missing_values", "activation_rate")] == 1
    assert issues[("missing_values", "fill_rate")] == 1
    assert issues[("rate_range", "trc_usage_rate")] == 1
    assert issues[("rate_range", "gross_margin")] == 1
    assert issues[("non_negative", "cpm")] == 1
    assert issues[("non_negative", "households")] == 1
    assert issues[("inverted_retention", "month_12_retention")] == 1
    clean = v.clean.collect()
    assert len(clean) == 4
    assert all(0 <= r.trc_usage_rate <= 1 and r.cpm >= 0 and r.households >= 0 and r.gross_margin >= 0
               for r in clean)
    seqs = [r.seq for r in v.issues.orderBy("seq").collect()]
    assert seqs == sorted(seqs)


def test_inverted_counted_after_clip(spark):
    rows = golden_rows(1, month_12_retention=1.5, month_1_retention=1.0)
    v = validate(cohort_df(spark, rows))
    assert not any(r.check == "inverted_retention" for r in v.issues.collect())


def test_empty_result_is_an_error(spark):
    rows = golden_rows(2, cpm=None)
    v = validate(cohort_df(spark, rows))
    assert v.errors == ["No valid rows remain after cleaning."]


def test_issue_counts_long_shape(spark):
    from cohortlens.operators.quality import issue_counts_long
    out = issue_counts_long(cohort_df(spark, golden_rows(3)))
    assert out.count() == len(REQUIRED_COLUMNS) + 10 + 6 + 3
    assert {r.n_rows for r in out.where("check = 'rows_read'").collect()} == {3}
