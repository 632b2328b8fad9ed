"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from conftest import SF, rows

from factloom.oracle import ORACLES
from factloom.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck):
    got, want = QUERIES[name](spark, str(SF)).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
