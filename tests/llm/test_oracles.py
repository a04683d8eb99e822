"""The corpus queries that SQL can express, against that SQL."""

import pytest

from sylva.llm import queries
from tests import oracle

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert oracle.difference(spark, oracle.connect(), queries.queries()[name], SQL[name]) == ""
