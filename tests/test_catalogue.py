"""Each catalogue query against its SQL over the smallest tables."""

import pytest

from lucidoc.plans.catalogue import QUERIES
from lucidoc.plans.oracles import ORACLE_SQL

from .duck import both, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    got, want = both(QUERIES[name](spark, SF), ORACLE_SQL[name], con)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
