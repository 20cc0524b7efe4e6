"""The operators that SQL can express, against their SQL."""

import oracle
import pytest

from quillon.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert oracle.compare(queries.QUERIES[name](spark, sf), oracle.connect(sf), queries.ORACLE_SQL[name]) == ""
