"""Points and spans by dyadic buckets, against every pair."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph, intervals, stabbing


def tables(spark, seed, low=0, files=3):
    rng = np.random.default_rng(seed)
    starts = rng.integers(low, low + 400, 150)
    spans = [(int(f), int(s), int(s + w), i) for i, (f, s, w) in enumerate(zip(rng.integers(0, files, 150), starts, rng.integers(-2, 120, 150)))]
    points = [(int(f), int(p)) for f, p in zip(rng.integers(0, files + 1, 200), rng.integers(low - 20, low + 600, 200))]
    return spans, points, spark.createDataFrame(spans, "file int, start int, end int, id int"), spark.createDataFrame(points, "file int, line int")


@pytest.mark.parametrize("low", [0, -150, 2_000_000_000])
def test_every_pair(spark, low):
    spans, points, s, p = tables(spark, abs(low) % 97, low)
    start, end = F.col("start"), F.col("end")
    inside = {q: [x for x in spans if x[0] == q[0] and x[1] <= q[1] <= x[2]] for q in set(points)}
    got = {(r["file"], r["line"]): tuple(r["least"]) for r in stabbing.least_holding(p, s, ["file"], "line", start, end, F.struct((end - start).alias("w"), "start", "id")).collect()}
    assert got == {q: min((e - a, a, i) for _, a, e, i in x) for q, x in inside.items() if x}
    assert {tuple(r) for r in intervals.unseen(p, s, ["file"]).collect()} == {q for q, x in inside.items() if not x}
    before = {q: [(a, i) for f, a, _, i in spans if f == q[0] and a <= q[1]] for q in set(points)}
    got = {(r["file"], r["line"]): tuple(r["last"]) for r in stabbing.last_before(p, s, ["file"], "line", start, F.struct("start", "id")).collect()}
    assert got == {q: max(x) for q, x in before.items() if x}
    near = {q: [max(0, a - q[1], q[1] - max(a, e)) for f, a, e, _ in spans if f == q[0]] for q in set(points)}
    assert {tuple(r) for r in intervals.distance(p, s, ["file"]).collect()} == {(*q, min(x)) for q, x in near.items() if x}


def test_enclosing(spark):
    spans, points, s, p = tables(spark, 5)
    got = {(r["file"], r["line"]): (r["enclosing_id"], r["exact"]) for r in graph.enclosing(p, s).collect()}
    for f, line in points:
        mine = [x for x in spans if x[0] == f]
        inside = [(e - a, a, i) for _, a, e, i in mine if a <= line <= e]
        before = [(a, i) for _, a, _, i in mine if a <= line]
        assert got[f, line] == ((min(inside)[2], True) if inside else (max(before)[1] if before else None, False))


def test_span_nodes_are_a_partition(spark):
    s = spark.createDataFrame([(a, b) for a in range(20) for b in range(a - 1, 20)], "a long, b long")
    for row in stabbing.span_nodes(s, F.col("a"), F.col("b"), 0, 6).groupBy("a", "b").agg(F.collect_list(F.struct("k", "i")).alias("n")).collect():
        points = [x for n in row["n"] for x in range(n["i"] << n["k"], n["i"] + 1 << n["k"])]
        assert sorted(points) == list(range(row["a"], row["b"] + 1))
        assert len(row["n"]) <= 2 * 5


def test_empty(spark):
    _, _, s, p = tables(spark, 1)
    assert intervals.unseen(p, s.limit(0), ["file"]).count() == p.count()
    assert intervals.distance(p, s.limit(0), ["file"]).count() == 0 == intervals.distance(p.limit(0), s, ["file"]).count()
    assert graph.enclosing(p.limit(0), s).count() == 0


def test_one_file_with_many(spark):
    """A file with all spans and points: in proportion, and no range left in the plan."""
    n = 300_000
    spans = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("start"), (F.col("id") + F.pmod(F.xxhash64("id"), F.lit(n))).alias("end"), "id")
    points = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("line"))
    out = graph.enclosing(points, spans)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and not re.search(r"Join.*(<=|>=)", plan)
    began = time.time()
    assert out.filter("exact").count() == n
    assert time.time() - began < 120


@pytest.mark.parametrize("length", [1, 70, 400])
def test_points_in_spans_by_masks(spark, length):
    """Spans within a word, over an end of one and over whole words, below and above 0, with nulls and spans that end before they start."""
    r = random.Random(length)
    points = [(r.choice("ab"), r.randint(-300, 900)) for _ in range(300)] + [("a", None), (None, 5), ("c", 3)]
    spans = [(r.choice("ab"), x, x + r.randint(-2, length)) for x in (r.randint(-300, 900) for _ in range(12))] + [("a", None, 5), (None, 0, 9)]
    p, s = spark.createDataFrame(points, "f string, at int"), spark.createDataFrame(spans, "f string, s int, e int")
    got = stabbing.held(p, s, ["f"], "at", F.col("s"), F.col("e"))
    want = {(k, at) for k, at in points if k and at is not None and any(k == k2 and a is not None and a <= at <= b for k2, a, b in spans)}
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.schema["at"].dataType.simpleString() == "int"


def test_points_are_shuffled_once(spark, monkeypatch):
    """A point is not a row for each level: spans of some lines are masks, and levels are for words that lie inside spans."""
    p = spark.range(4096).select((F.col("id") % 4).alias("f"), F.expr("cast(id div 4 as int)").alias("at"))
    s = spark.range(64).select((F.col("id") % 4).alias("f"), (F.col("id") * 16).alias("s"), (F.col("id") * 16 + 4).alias("e"))
    monkeypatch.setattr(stabbing, "_at_levels", lambda *_: pytest.fail("rows for each level"))
    assert stabbing.held(p, s, ["f"], "at", F.col("s"), F.col("e")).count() == 64 * 5
