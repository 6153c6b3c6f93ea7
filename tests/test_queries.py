"""Every registered query against its SQL on the smallest tables, and the flagship entry."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

Q, SQL = entry.queries(), entry.oracle_sql()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    ok, msg = compare(Q[name](spark, SF), con, SQL[name])
    assert ok, msg


def test_every_sql_has_a_query():
    assert set(SQL) <= set(Q)


def test_entry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and all(0 <= r.fused <= 1 and 0.30 <= r.confidence <= 0.92 for r in rows)
    assert {r.risk_band for r in rows} <= {"low", "elevated", "high"}


@pytest.mark.parametrize("name", sorted(Q))
def test_no_pair_products_in_plans(spark, name):
    if name in ("q_components", "q_knn_ratio"):
        pytest.skip("iterative, covered by its own tests")
    plan = Q[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
