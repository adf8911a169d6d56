"""Every registered query of the engine against its SQL in DuckDB."""

import pytest
from oracle import assert_same
from quillon.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name], SF)


def test_explain_has_three_plans(spark):
    rows = catalog.QUERIES["explain"](spark, SF).collect()
    assert [r.explain_type for r in rows] == ["logical_plan", "logical_plan_opt", "physical_plan"]
    assert "Filter" in rows[0].explain_value


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["filter_and"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_entry_has_all_queries(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:2] == ["l_returnflag", "l_linestatus"]
