"""Calls and functions of a key meet in blocks: the pairs are those of a join, and take little room where they are written."""

import os

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import resolve


@pytest.mark.parametrize("sizes", [(3, 2), (1, 1), (512, 256)])
def test_blocks_give_the_pairs_of_a_join(spark, monkeypatch, sizes):
    monkeypatch.setattr(resolve, "CALL_BLOCK", sizes[0])
    monkeypatch.setattr(resolve, "FUNCTION_BLOCK", sizes[1])
    asks = spark.createDataFrame([(f"k{i % 4}" if i % 9 else None, i % 3 == 0, f"c{i % 11}", None if i % 5 == 0 else "x") for i in range(60)], "key string, tail boolean, caller string, recv_arg string")
    names = spark.createDataFrame([(f"k{i % 5}" if i % 8 else None, i % 2 == 0, f"f{i % 9}") for i in range(50)], "key string, tail boolean, id string")
    got = resolve.met(asks, names, ["key", "tail"])
    assert got.columns == ["key", "tail", "caller", "recv_arg", "id"]
    want = asks.join(names, ["key", "tail"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_pairs_take_little_room(spark, tmp_path):
    calls = spark.range(8000).select(F.concat(F.lit("c"), F.col("id") * 7919 % 1000).alias("caller"), F.concat(F.lit("n"), F.xxhash64("id") % 40).alias("callee_name"), F.lit(0).alias("arity"), F.lit("typed").alias("recv_kind"), F.lit("A").alias("recv_arg"))
    symbols = spark.range(8000).select(F.concat(F.lit("f"), "id").alias("id"), F.concat(F.lit("A::n"), F.xxhash64("id") % 40).alias("qualified"), F.lit("fn").alias("kind"))
    edges = resolve.resolve_typed(calls, symbols)
    edges.write.parquet(path := str(tmp_path / "edges"))
    rows = spark.read.parquet(path).count()
    size = sum(os.path.getsize(f"{path}/{x}") for x in os.listdir(path) if x.endswith(".parquet"))
    assert rows > 500_000 and size < 0.5 * rows
