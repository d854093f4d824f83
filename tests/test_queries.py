"""Every registered query with comparison SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    message, ok = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), sf)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_plans_have_no_row_python(spark, sf):
    for name in ("studies_index", "qido_filter", "deduplicate", "sync_plan", "frame_rows", "multipart_fields", "multipart_scan"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
