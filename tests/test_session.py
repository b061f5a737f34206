"""Shared-folder helpers: checkpoint folder from the session, parquet materialisation."""

import os

from cohortlens.session import ensure_checkpoint_dir, materialize, table_path


def test_checkpoint_dir_comes_from_the_session(spark):
    d = ensure_checkpoint_dir(spark)
    assert d == spark.sparkContext._jsc.sc().getCheckpointDir().get()
    assert table_path(spark, "x").startswith(os.path.join(d, "tables"))


def test_materialize_round_trip_and_pruning(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS twice", "CAST(id AS STRING) AS s")
    m = materialize(df, "unit")
    assert sorted(m.columns) == ["id", "s", "twice"] and m.count() == 100
    plan = m.select("twice").where("twice > 10")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "ReadSchema: struct<twice:bigint>" in plan
