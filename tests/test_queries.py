import pytest

from latticeq.plans import registry

from .helpers import SMALL, oracle, rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    own, sql = registry.QUERIES[name](spark, SMALL).toPandas(), oracle(registry.ORACLE_SQL[name])
    assert sorted(own.columns) == sorted(sql.columns)
    assert rows_of(own) == rows_of(sql)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
