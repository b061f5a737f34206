"""S1-S7 sources and sinks: CSV typing, default dataset, facts builder, synthetic generator, sink."""

import os
import tempfile

from pyspark.sql import functions as F

from cohortlens.operators.quality import validate
from cohortlens.schema import REQUIRED_COLUMNS
from cohortlens.sources import facts, files, synthetic
from tests.conftest import GOLDEN, SF_SMALL


def test_cohort_csv_with_na_tokens_and_bom(spark):
    d = tempfile.mkdtemp(prefix="cl-csv-")
    path = os.path.join(d, "c.csv")
    header = ",".join(REQUIRED_COLUMNS + ["note"])
    good = ",".join(str(GOLDEN[c]) for c in REQUIRED_COLUMNS) + ",x"
    na_row = good.replace("0.86", "NA", 1)
    nan_row = good.replace("0.42", "nan", 1)
    junk = good.replace("32.0", "abc", 1)
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("\n".join([header, good, na_row, nan_row, junk]) + "\n")
    df = files.read_cohort_csv(spark, path)
    assert df.columns == REQUIRED_COLUMNS + ["note"]
    assert dict(df.dtypes)["households"] == "double" and dict(df.dtypes)["cpm"] == "double"
    v = validate(df)
    assert v.rows_in == 4 and v.rows_out == 1
    miss = {r.column: r.n_rows for r in v.issues.collect() if r.check == "missing_values"}
    assert miss == {"activation_rate": 1, "trc_usage_rate": 1, "cpm": 1}


def test_ensure_dataset_and_sink(spark):
    d = tempfile.mkdtemp(prefix="cl-ds-")
    path = os.path.join(d, "default")
    a = files.ensure_dataset(spark, path, lambda s: synthetic.generate_cohorts(s))
    b = files.ensure_dataset(spark, path, lambda s: synthetic.generate_cohorts(s, seed=7))  # ignored: exists
    assert a.count() == b.count() == 288
    assert sorted(r[0] for r in a.exceptAll(b).limit(1).collect()) == []
    out = os.path.join(d, "out")
    files.write_results(a.groupBy("market").count(), out, partition_by=["market"])
    assert sorted(os.listdir(out))[0].startswith("_SUCCESS") or any(x.startswith("market=") for x in os.listdir(out))


def test_synthetic_generator(spark):
    g = synthetic.generate_cohorts(spark, replicas=2, num_partitions=3)
    assert g.count() == 576
    assert g.select("cohort_month").distinct().count() == 24
    r = g.agg(F.min("month_1_retention"), F.max("month_1_retention"), F.min("trc_usage_rate"),
              F.max("trc_usage_rate"), F.min("households")).first()
    assert 0.40 <= r[0] and r[1] <= 0.95 and 0.05 <= r[2] and r[3] <= 0.85 and r[4] > 0
    again = synthetic.generate_cohorts(spark, replicas=2, num_partitions=5)
    assert g.exceptAll(again).count() == 0  # reproducible under any partitioning
    v = validate(g)
    assert v.rows_out == 576 and not v.errors


def test_synthetic_months_keep_four_digit_years(spark):
    g = synthetic.generate_cohorts(spark, replicas=9000).select("cohort_month")
    assert g.agg(F.max(F.length("cohort_month")), F.min("cohort_month"), F.max("cohort_month")).first() == (7, "2025-01", "9999-12")


def test_household_grain(spark):
    c = facts.cohorts_from_facts(spark, SF_SMALL, per_household=True)
    assert c.columns == ["custkey", *REQUIRED_COLUMNS]
    rows, customers, households = c.agg(F.count("*"), F.count_distinct("custkey"), F.sum("households")).first()
    assert rows == customers == households == facts.cohorts_from_facts(spark, SF_SMALL).agg(F.sum("households")).first()[0]


def test_cohorts_do_not_depend_on_the_partitioning(spark, tmp_path):
    for n in ("orders", "customer", "nation", "region"):
        os.symlink(os.path.join(SF_SMALL, f"{n}.parquet"), tmp_path / f"{n}.parquet")
    facts.read_table(spark, SF_SMALL, "lineitem").repartition(7, F.rand(1)).write.parquet(str(tmp_path / "lineitem.parquet"))
    a, b = facts.cohorts_from_facts(spark, SF_SMALL), facts.cohorts_from_facts(spark, str(tmp_path))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_cohorts_from_facts_small(spark):
    c = facts.cohorts_from_facts(spark, SF_SMALL)
    assert c.columns == REQUIRED_COLUMNS
    n = c.count()
    assert n == 146  # FIXTURES section 2
    assert c.agg(F.sum("households")).first()[0] == 150
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_initiative_csv_upload(spark):
    from cohortlens.plans.catalog import UPLOAD_CSV
    df = files.read_initiatives_csv(spark, UPLOAD_CSV)
    assert "initiative" in df.columns and "retention_risk" not in df.columns
    from cohortlens.operators.portfolio import clean_initiatives
    names = [r.initiative for r in clean_initiatives(df).collect()]
    assert len(names) == 6 and "" not in names


def test_csv_dialect_keeps_quotes_line_breaks_and_fractions(spark):
    d = tempfile.mkdtemp(prefix="cl-csv-")
    path = os.path.join(d, "c.csv")
    good = ",".join(str(GOLDEN[c]) for c in REQUIRED_COLUMNS)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(",".join(REQUIRED_COLUMNS + ["note"]) + "\n")
        f.write(good.replace("1000", "1000.5", 1) + ',"say ""hi"", now"\n')
        f.write(good + ',"line one\nline two"\n')
        f.write(good.replace("Mexico", "n/a", 1) + ",x\n")
    df = files.read_cohort_csv(spark, path)
    rows = df.orderBy("note").collect()
    assert [(r.households, r.market, r.note) for r in rows] == [
        (1000.0, "Mexico", "line one\nline two"), (1000.5, "Mexico", 'say "hi", now'), (1000.0, None, "x")]
    assert validate(df).rows_out == 2
    out = os.path.join(d, "out")
    files.write_results(df, out, fmt="csv")
    assert {r.note for r in files.read_cohort_csv(spark, out).collect()} == {r.note for r in rows}


def test_share_upload_copies_the_file_as_it_is(spark):
    from cohortlens.plans.catalog import UPLOAD_CSV
    shared = files.share_upload(spark, UPLOAD_CSV)
    assert files.share_upload(spark, f"file://{UPLOAD_CSV}") == f"file://{UPLOAD_CSV}"
    assert files.read_initiatives_csv(spark, shared).collect() == files.read_initiatives_csv(spark, UPLOAD_CSV).collect()
