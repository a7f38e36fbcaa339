import pytest

from loam.queries import REGISTRY


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_query_equals_its_sql(spark, oracle, name):
    oracle(spark, *REGISTRY[name])


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if not sql])
def test_query_without_sql_runs(spark, name):
    assert REGISTRY[name][0](spark, "/root/testdata/sf0.001").columns
