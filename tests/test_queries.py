"""Every query of the core against its SQL, or at least run, on the smallest tables."""

import pytest

from inkwell.plans import registry
from tests.conftest import compare

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, sf_dir, name):
    compare(spark, duck, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    from inkwell.operators import store
    from inkwell.plans.registry import table

    plan = store.get(table(spark, sf_dir, "chunks").select("id", "content"), "id", "x")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,x)" in plan and "embedding" not in plan
