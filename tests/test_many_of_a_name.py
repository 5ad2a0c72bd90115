"""Many functions of one name: what is shuffled and written goes by calls and names, not by pairs of calls and functions."""

import pytest

from sparkloom.operators import explore, resolve

CALLS = "caller string, callee_name string, arity long, recv_kind string, recv_arg string"
SYMBOLS = "id string, name string, qualified string, kind string, file string, start_line int, end_line int, arity long"


@pytest.fixture
def tables(spark):
    fns = [(f"f{i}", "run", "A::run" if i % 2 else "p::A::run", "fn", f"file{i}", 1, 2, 0) for i in range(50)]
    fns += [("twice", "run", "A::run", "fn", "x", 1, 2, 0), ("twice", "run", "A.run", "fn", "x", 1, 2, 0), ("far", "go", "p::B::go", "fn", "x", 1, 2, 0)]
    calls = [("f1", "A::run", n, "free", "") for n in range(3)] + [("f1", "run", 0, "path", "A"), ("f2", "run", 0, "typed", "A"), ("f3", "run", 0, "dyn", "T"), ("f4", "go", 0, "path", "B"), ("f5", "run", 0, "unknown", "")]
    impls = spark.createDataFrame([("A", "T")], "type_name string, trait_name string")
    return spark.createDataFrame(calls, CALLS), spark.createDataFrame(fns, SYMBOLS), impls


def test_resolved_has_calls_not_pairs(tables):
    assert resolve.resolved(*tables).count() == 8  # one has two keys


def test_what_is_written_goes_by_calls(spark, tables, monkeypatch):
    sizes, keep = [], resolve.shared.written

    def written(df, name, **options):
        out = keep(df, name, **options)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(resolve.shared, "written", written)
    edges = resolve.resolve_calls(*tables)
    rows = [(r.src, r.dst, r.confidence) for r in edges.collect()]
    assert sum(sizes) < 20
    assert len(rows) == len(set(rows))
    own = {f"f{i}" for i in range(1, 50, 2)} | {"twice"}
    want = {(src, dst, tier) for src, tier in (("f1", "direct"), ("f2", "typed"), ("f3", "dyn")) for dst in own} | {("f4", "far", "direct")}
    assert {r for r in rows if r[2] != "name"} == want
    assert {r[0] for r in rows if r[2] == "name"} == {"f5"} and len(rows) == len(want) + 8


def test_pairs_are_made_in_all_partitions(spark, tables):
    assert resolve.match_dyn(*tables).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_reports_by_names(spark, tables):
    calls, symbols, impls = tables
    calls = calls.unionByName(spark.createDataFrame([("g", "A::run", 0, "free", ""), ("f7", "go", 0, "path", "B"), ("far", "A::run", 0, "free", "")], CALLS))
    methods = spark.createDataFrame([("f1", "B")], "method_id string, type_qualified string")
    refs = spark.createDataFrame([], "referrer string, type_name string")
    symbols = symbols.unionByName(spark.createDataFrame([("B", "B", "B", "type", "b", 1, 2, -1)], SYMBOLS))
    whole = resolve.resolve_edges(calls, symbols, impls, methods, refs)
    edges, names = resolve.keyed_edges(calls, symbols, impls, methods)
    assert edges.count() < 25 < whole.count()
    shown = spark.createDataFrame([(1, "far"), (2, "f3"), (3, "twice"), (4, "B")], "place int, id string")
    assert sorted(explore.report(shown, symbols, edges, names).collect()) == sorted(explore.report(shown, symbols, whole).collect())
