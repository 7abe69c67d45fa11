"""Every query with SQL against DuckDB; the entry module's contract."""

import importlib
import sys

import pytest

from joinery.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_run_report_has_every_phase(spark, sf):
    got = {r["name"]: r for r in QUERIES["run_report"](spark, sf).collect()}
    assert set(got) == {"JTOTAL", "JHIST", "JMPI", "JPROC", "RESULTS"}
    assert got["RESULTS"]["total"] == 6000
    assert got["JTOTAL"]["total"] >= got["JHIST"]["total"]


def test_run_phases(spark, sf):
    got = {r["name"]: r for r in QUERIES["run_phases"](spark, sf).collect()}
    assert {"JTOTAL", "HILOCAL", "HOOFFCOMP", "MIMAINPART", "LPPART", "BPBUILD", "BPPROBE"} <= set(got)
    assert got["JTOTAL"]["total"] >= got["BPBUILD"]["total"] and all(r["unit"] == "us" for r in got.values())


def test_histograms_read_each_side_once(spark, sf):
    plan = QUERIES["histogram_computation"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("FileScan") == 2


def test_a_look_into_a_relation_leaves_no_row_out(spark, sf):
    got = QUERIES["debug_all_keys"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert got.filter("shown <> key % 1000 or shown is null").count() == 0


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.columns == ["pid", "matches"] and got.count() == 32
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_parts(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "joinery.llm", raising=False)
    try:
        again = importlib.reload(__spark_entry__)
        assert again.llm is None and set(again.queries()) == set(QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
