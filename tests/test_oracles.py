"""Every query of the library that has SQL agrees with it on the smallest tables."""

import pytest
from oracle import differences

from tessera.queries import all_queries

QUERIES, SQL = all_queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, data, name):
    assert differences(spark, QUERIES[name], SQL[name], data) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"expression_search"}))
def test_query_without_sql_gives_rows(spark, data, name):
    frame = QUERIES[name](spark, data)
    assert len(set(frame.columns)) == len(frame.columns)
    assert frame.count() > 0
