import pytest
from oracle import DATA, same

from siftline.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_oracle(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_screen_is_catalyst_only(spark):
    plan = catalog.QUERIES["screen_verdict"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema" in plan


def test_memory_join_is_anti(spark):
    plan = catalog.QUERIES["anti_join_memory"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "text" not in plan.split("ReadSchema")[1].split(">")[0]


def test_each_keyword_is_looked_for_once(spark):
    for name, n in (("screen_verdict", len(catalog.GOOD + catalog.BAD)), ("screen_keyword_list", len(catalog.GOOD))):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RLIKE") == n, plan
