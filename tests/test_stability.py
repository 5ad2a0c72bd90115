"""Stability timers of a stream against the batch form."""

import datetime
import random

import pytest

from sparkloom.operators import catalog
from sparkloom.sources import shared
from sparkloom.streaming import stability

def run(spark, files, late):
    """The rebuilds of a stream that gets one file a micro-batch."""
    path = shared.scratch(spark, "samples")
    out = shared.scratch(spark, "rebuilds")
    schema = "root string, ts timestamp, f string"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        samples = spark.readStream.schema(schema).parquet(path)
        made = stability.rebuilds(samples, "root", "ts", "f", 10, late)
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.schema(made.schema).parquet(out).collect()))


@pytest.mark.parametrize("shuffled", [False, True])
def test_as_the_batch_form(spark, shuffled):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for root in "abcde":
        at, f = 0.0, "x"
        for _ in range(40):
            at += rng.choice([1.0, 3.5, 5.0, 12.0])
            f = f if rng.random() < 0.7 else rng.choice("xyz")
            rows.append((root, start + datetime.timedelta(seconds=at), f))
    rows.sort(key=lambda r: r[1])
    if shuffled:  # out of order by up to some seconds
        rows.sort(key=lambda r: r[1] + datetime.timedelta(seconds=rng.uniform(0, 20)))
    end = ("end", max(r[1] for r in rows) + datetime.timedelta(hours=1), "e")  # moves the watermark past all others
    n = -(-len(rows) // 3)
    got = run(spark, [rows[:n], rows[n : 2 * n], [*rows[2 * n :], end]], "60 seconds")
    expected = catalog.stable_rebuilds(spark.createDataFrame(rows, "root string, ts timestamp, f string"), ["root"], "ts", "f", 10)
    assert got == sorted(map(tuple, expected.select("root", "ts", "f").collect())) and len(got) > 5


def test_what_the_watermark_has_not_passed_waits(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", at(0), "x"), ("a", at(1), "y"), ("a", at(12), "y"), ("a", at(20), "z")]
    assert run(spark, [rows], "30 seconds") == []
    assert run(spark, [rows, [("b", at(100), "x")]], "30 seconds") == [("a", at(12), "y")]
