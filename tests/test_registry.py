"""Every registered query beside its SQL, and the shape of the plans."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

ORACLES = entry.oracle_sql()
# Joins that need a second execution to plan are covered by the comparison.
PLANNED = [n for n in ORACLES if n not in ("scan_survey", "roundtrip")]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, sf_dir, name):
    ok, message = compare(spark, con, sf_dir, entry.queries()[name], ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", sorted(PLANNED))
def test_plan_has_no_cross_product_and_no_python(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas"):
        assert bad not in plan


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "fired_key" and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["burnt_tables", "burnt_tables_abundance"])
def test_burnt_tables_store_no_column_that_nothing_reads(spark, sf_dir, name, monkeypatch):
    from registry import queries

    stored = {}
    monkeypatch.setattr(queries, "materialize", lambda df, what="table": stored.setdefault(what, df))
    entry.queries()[name](spark, sf_dir)
    unread = {"fired_key", "latitude", "longitude", "x", "y", "date_text", "before_after", "project_name"}
    assert {"survey", "clean"} <= set(stored)
    assert all(unread.isdisjoint(df.columns) for df in stored.values())
