"""Every registered catalog query against its SQL."""

import pytest

from sylva import queries
from tests import oracle

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


def test_every_query_has_sql():
    assert set(queries.queries()) == set(SQL)


#: These have no rows where all is well.
EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    assert oracle.difference(spark, con, queries.queries()[name], SQL[name]) == ""
    if name not in EMPTY:
        assert con.execute(SQL[name]).fetchone() is not None, "it shows nothing"
