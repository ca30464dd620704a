"""Runs written twice or broken off, and detection as a table function."""

import pytest

from sablespan.operators.extract import RECOGNIZERS, find_spans
from sablespan.operators.table_function import register
from sablespan.sources import files as S

METRICS = "run_id string, test_id string, metric string, value double"


def rows_of(df):
    return sorted((r["run_id"], r["test_id"], r["value"]) for r in df.collect())


def test_runs_replace_and_break_off(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "runs")
    S.write_run(spark.createDataFrame([("r1", "t1", "f1", 0.5), ("r1", "t2", "f1", 0.25), ("r2", "t1", "f1", 1.0)], METRICS), path)
    assert rows_of(S.read_runs(spark, path, "r1", "r2")) == [("r1", "t1", 0.5), ("r1", "t2", 0.25), ("r2", "t1", 1.0)]
    S.write_run(spark.createDataFrame([("r1", "t1", "f1", 0.75)], METRICS), path)
    want = [("r1", "t1", 0.75), ("r2", "t1", 1.0)]
    assert rows_of(S.read_runs(spark, path, "r1", "r2")) == want

    def broken(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(S, "_complete", broken)
        with pytest.raises(OSError):
            S.write_run(spark.createDataFrame([("r1", "t9", "f1", 0.0), ("r3", "t1", "f1", 0.0)], METRICS), path)
    assert rows_of(S.read_runs(spark, path, "r1", "r2", "r3")) == want
    assert rows_of(S.read_runs(spark, path, "r3")) == []
    plan = S.read_runs(spark, path, "r2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "r2" in plan


def test_table_function(spark):
    register(spark)
    rows = [(1, "GPA: 3.5 and 3.25/4.0"), (2, None), (3, ""), (4, "50% Disabled, taking aspirin 😀 GPA 2.0")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    docs.createOrReplaceTempView("docs_of_function")
    got = spark.sql("SELECT * FROM detect(TABLE(docs_of_function), 'GPA', 'PHI')")
    want = find_spans(docs, [*RECOGNIZERS["GPA"], *RECOGNIZERS["PHI"]])
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() >= 4
    every = spark.sql("SELECT * FROM detect(TABLE(docs_of_function))")
    assert {r["entity_type"] for r in every.collect()} >= {"GPA", "PHI"}
    for call in ("detect(TABLE(docs_of_function), 'NOTHING')", "detect(TABLE(SELECT 1 AS x), 'GPA')", "detect('GPA')"):
        with pytest.raises(Exception, match="detect"):
            spark.sql(f"SELECT * FROM {call}")  # refused when analysed: nothing runs
