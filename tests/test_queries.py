"""Every registered query against its SQL twin, and its plan against shapes that do not scale."""

import pytest
from compare import connect, difference
from plan_scan import findings

import __spark_entry__ as entry
from tidewatch.plans.registry import QUERIES

ROWS_ONLY = {"drift_isolation_forest", "quality_outlier_forest"}


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data_dir, con, name):
    df = entry.queries()[name](spark, data_dir)
    sql = entry.oracle_sql().get(name)
    plan = findings(df._jdf.queryExecution().executedPlan().toString())
    assert not {"CartesianProduct", "BroadcastNestedLoopJoin", "row-at-a-time Python"} & set(plan)
    if sql is None:
        assert name in ROWS_ONLY
        assert df.count() > 0
    else:
        assert difference(df, con, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
