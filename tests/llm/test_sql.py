"""Every operator whose results SQL can say against DuckDB on the smallest tables."""

import oracle
import pytest
from conftest import SMALL

from keyfold.llm import queries

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.differences(con, queries.queries()[name](spark, SMALL), SQL[name]) == ""
