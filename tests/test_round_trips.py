"""Sources, sinks and streams that must survive a lost driver, and files with faults."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import portfolio
from cohortlens.operators.quality import validate
from cohortlens.schema import REQUIRED_COLUMNS
from cohortlens.sources import files
from cohortlens.streaming.drafts import verified_drafts, verify_draft_stream
from tests.conftest import GOLDEN, cohort_df, golden_rows

FACTS = "context_id string, path string, value_double double, value_string string"


def test_half_written_dataset_is_built_again(spark, tmp_path):
    path = str(tmp_path / "data")
    first = files.ensure_dataset(spark, path, lambda s: s.range(10).repartition(4))
    assert first.count() == 10 and files.ensure_dataset(spark, path, lambda s: s.range(99)).count() == 10
    os.remove(f"{path}/_SUCCESS")
    next(p for p in (tmp_path / "data").iterdir() if p.name.startswith("part-")).unlink()
    assert files.ensure_dataset(spark, path, lambda s: s.range(20)).count() == 20
    assert [p.name for p in tmp_path.iterdir()] == ["data"]  # nothing is left beside it


def test_dataset_that_cannot_be_built_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "data")
    with pytest.raises(Exception):
        files.ensure_dataset(spark, path, lambda s: s.range(3).select(F.raise_error(F.lit("lost"))))
    assert not os.path.exists(path)
    os.makedirs(path)
    (tmp_path / "data" / "notes.txt").write_text("mine")
    with pytest.raises(ValueError, match="no dataset"):
        files.ensure_dataset(spark, path, lambda s: s.range(3))
    assert (tmp_path / "data" / "notes.txt").read_text() == "mine"


@pytest.mark.parametrize("line_breaks", [True, False])
def test_malformed_csv_rows(spark, tmp_path, line_breaks):
    good = ",".join(str(GOLDEN[c]) for c in REQUIRED_COLUMNS) + ",x"
    rows = [good, good + ",y,z", good.replace("Mexico", " US "), good.replace("0.86", "0.5d"), good.replace("0.86", " 0.25 "),
            ",".join(good.split(",")[:3]), good[:-1] + '"a, ""b"", c"', good[:-1] + '"a, b",more', good.replace("0.86", "1e-1")]
    path = tmp_path / "c.csv"
    path.write_text("\n".join([",".join([*REQUIRED_COLUMNS, "note"]), *rows]) + "\n")
    df, bad = files.read_cohort_csv(spark, str(path), line_breaks), files.rejected_rows(spark, str(path), line_breaks)
    n = len(REQUIRED_COLUMNS) + 1
    assert sorted(map(tuple, bad.collect())) == sorted([(f"{n + 2} cells, {n} columns", rows[1]), (f"{n + 1} cells, {n} columns", rows[7])])
    got = df.collect()
    assert len(got) == 7 and df.columns == [*REQUIRED_COLUMNS, "note"]
    assert sorted(r.market for r in got) == [" US ", *["Mexico"] * 6]
    assert sorted((r.activation_rate is None, r.activation_rate or 0) for r in got)[0] == (False, 0.1)
    assert sorted(r.activation_rate for r in got if r.activation_rate is not None) == [0.1, 0.25, 0.86, 0.86, 0.86]
    assert {r.note for r in got} == {"x", None, 'a, "b", c'}
    v = validate(df, bad)
    assert (v.rows_in, v.rows_out) == (7, 5)
    assert [(r.seq, r.check, r.n_rows) for r in v.issues.orderBy("seq").collect()][:1] == [(1, "malformed_rows", 2)]
    assert v.issues.count() == validate(df).issues.count() + 1


def test_touched_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = cohort_df(spark, golden_rows(50, market="A") + golden_rows(30, market="B")).repartition(8)
    files.write_results(rows, path, partition_by=["market"], rows_per_file=20)
    a, b = (sorted(p.name for p in (tmp_path / "out" / f"market={m}").glob("*.parquet")) for m in "AB")
    assert len(a) >= 3 and len(a) + len(b) <= 8  # 20 rows each at most, not a file for each task and partition
    files.write_results(cohort_df(spark, golden_rows(5, market="B") + golden_rows(2, market="C")), path, partition_by=["market"], touched_only=True)
    assert {r.market: r["count"] for r in spark.read.parquet(path).groupBy("market").count().collect()} == {"A": 50, "B": 5, "C": 2}
    assert sorted(p.name for p in (tmp_path / "out" / "market=A").glob("*.parquet")) == a
    with pytest.raises(ValueError):
        files.write_results(rows, path, touched_only=True)
    files.write_results(rows.where("market = 'A'"), path, partition_by=["market"])
    assert {r.market for r in spark.read.parquet(path).collect()} == {"A"}


def test_initiative_edits(spark):
    table = spark.createDataFrame([("A", 0.1, 5.0, "t"), (" B ", 0.2, 6.0, None), ("C", 0.3, 7.0, "u"), ("C", 0.4, 8.0, "v")], "initiative string, cpm_lift double, cost double, thesis string")
    for f in portfolio.INITIATIVE_SCHEMA.fields:
        if f.name not in table.columns:
            table = table.withColumn(f.name, F.lit(None).cast(f.dataType))
    changes = spark.createDataFrame([("A", None, 9.0, None), ("B", None, None, True), (" C", 0.5, None, False), ("D", None, 1.0, None), ("E", None, None, True), (None, 1.0, 1.0, None), (" ", 1.0, 1.0, None),
                                     ("A", None, 2.0, None)], "initiative string, cpm_lift double, cost double, removed boolean")
    got = portfolio.edit_initiatives(table, changes)
    assert got.columns == [f.name for f in portfolio.INITIATIVE_SCHEMA.fields]
    assert sorted((r.initiative, r.cpm_lift, r.cost, r.thesis) for r in got.collect() if r.initiative != "D") == [("A", 0.1, 9.0, "t"), ("C", 0.5, 7.0, "u"), ("C", 0.5, 8.0, "v")]
    assert [(r.cost, r.cpm_lift) for r in got.where("initiative = 'D'").collect()] == [(1.0, None)]
    same = portfolio.edit_initiatives(table, changes.limit(0))
    assert same.count() == 4 and portfolio.edit_initiatives(table.limit(0), changes).count() == 3


def _drafts(folder, name, ids):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(json.dumps({"draft_id": i, "context_id": "c", "text": "CLV $17.20 and 4.2x"}) for i in ids))


def test_stream_goes_on_in_another_session(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(session):
        facts = session.createDataFrame([("c", "kpi.avg_clv", 17.2, None)], FACTS)
        q = verify_draft_stream(session, src, facts, out, name=f"t{uuid.uuid4().hex[:8]}", max_files_per_trigger=1)
        assert q.awaitTermination(180)
        assert q.exception() is None

    _drafts(src, "a.json", ["1", "2"])
    _drafts(src, "b.json", ["3"])
    run(spark)
    # the driver is lost after the last batch was written and before it was committed
    last = max(int(p.name) for p in (tmp_path / "out" / "_checkpoint" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "out" / "_checkpoint" / "commits").iterdir():
        if p.name.strip(".").startswith(str(last)):
            p.unlink()
    assert verified_drafts(spark, out).count() < 3
    _drafts(src, "c.json", ["4", "5"])
    run(spark.newSession())
    for rows in (spark.read.parquet(out), verified_drafts(spark, out)):
        assert sorted(r.draft_id for r in rows.collect()) == ["1", "2", "3", "4", "5"]
        assert {(r.total, r.verified) for r in rows.collect()} == {(2, 1)}
