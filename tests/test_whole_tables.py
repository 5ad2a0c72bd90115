"""Queries over all of lineitem, and the name tier beside the tiers before it."""

import oracle
import pytest

from sparkloom import queries
from sparkloom.operators import resolve

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", ["resolve_free", "resolve_path", "resolve_typed", "resolve_dyn", "resolve_name"])
def test_calls_of_all_orders(spark, db, name):
    assert oracle.difference(spark, db, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) is None


def test_sql_reads_whole_tables():
    assert not [name for name, sql in queries.ORACLE_SQL.items() if "l_orderkey %" in sql]


def test_name_tier_takes_what_is_left(spark):
    symbols, calls, impls = queries.call_tables(spark, SF)
    done = resolve.resolved(calls, symbols, impls)
    typed = calls.filter("recv_kind = 'typed'").join(done, list(resolve.CALL), "left_semi")
    left = calls.filter("recv_kind = 'typed'").join(done, list(resolve.CALL), "left_anti")
    assert typed.count() > 0 and resolve.resolve_name(typed, symbols, done).count() == 0
    assert left.count() > 0 and resolve.resolve_name(left, symbols, done).count() > 0


@pytest.mark.parametrize("name", ["hunk_groups", "unseen_lines", "edit_overlaps"])
def test_spans_of_all_orders(spark, db, name):
    assert oracle.difference(spark, db, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) is None
