import pytest

from sluice import queries
from tests.compare import same


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_is_what_its_sql_says(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def test_entry_is_there(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = queries.QUERIES["filter_and_or"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
