"""Every reference query against its SQL, on the smallest tables."""

import oracle
import pytest

from sparkloom import queries, queries_edits, queries_index, queries_more  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.duck(SF)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, db, name):
    assert oracle.difference(spark, db, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) is None
