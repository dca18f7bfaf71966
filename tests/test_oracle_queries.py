import pytest

from tests import oracle
from ticketloom.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    oracle.assert_same(spark, name, catalogue.queries()[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalogue.queries())
