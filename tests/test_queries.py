"""Every query of the library against its SQL, and those without SQL for rows."""

import pytest

import __spark_entry__ as entry
from stallmetrics.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_has_rows(name, spark):
    assert not QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()


def test_entry_has_all(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
