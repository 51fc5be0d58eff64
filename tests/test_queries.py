"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from placewright.queries import ORACLE_SQL, QUERIES

from .conftest import SF, normal


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
