"""Every catalog query against its SQL on the smallest test tables."""

import pytest

import __spark_entry__
from servelog import catalog
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert difference(df, duck, SQL[name]) is None


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    rate = {r["policy"]: r["hit_rate"] for r in rows}
    assert set(rate) == {"affinity", "balanced"} and rate["affinity"] > rate["balanced"]
