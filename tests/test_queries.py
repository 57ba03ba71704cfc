import pytest

from tidemill.queries import ORACLE_SQL, QUERIES

from .conftest import SF, same_as_duckdb


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_duckdb(spark, name):
    same_as_duckdb(spark, name, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quantifiers_are_semi_and_anti_joins(spark):
    assert "LeftSemi" in plan(QUERIES["spec_exists_o2m"](spark, SF))
    anti = plan(QUERIES["spec_forall_o2m"](spark, SF))
    assert "LeftAnti" in anti and "<= 10.0" in anti
    assert plan(QUERIES["spec_nested_quantifier"](spark, SF)).count("LeftSemi") == 2


def test_groups_are_never_gathered(spark):
    for name in ("result_sequence", "event_fold"):
        assert "collect_list" not in plan(QUERIES[name](spark, SF)), name


def test_filters_reach_the_scan(spark):
    physical = QUERIES["spec_exists_o2m"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100000.0)" in physical and "o_orderdate" not in physical
