"""Every query with SQL, against DuckDB on the smallest tables."""

import pytest

import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return oracle.database(SF)


@pytest.mark.parametrize("name", sorted(oracle.entry.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    assert oracle.compare(spark, database, name, SF).startswith("ok")


def test_every_sql_has_a_query():
    assert set(oracle.entry.oracle_sql()) <= set(oracle.entry.queries())
