"""Every registered query of the core against DuckDB on the smallest tables; those without SQL must run."""

import pytest

import __spark_entry__ as entry
from compare import against_sql

SF = "/root/testdata/sf0.001"
QUERIES = {k: q for m in entry.CORE for k, q in __import__(m, fromlist=["queries"]).queries().items()}
SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    if name in SQL:
        against_sql(df, SQL[name], SF)
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(SQL) <= set(entry.queries())
