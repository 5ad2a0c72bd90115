"""Requests that come in one partition are parsed by all cores."""

from sparkloom.operators import requests
from sparkloom.sources import shared


def test_requests_are_dealt_out(spark, monkeypatch):
    parts, real = {}, shared.written

    def written(df, name, **options):
        parts[name] = df.rdd.getNumPartitions()
        return real(df, name, **options)

    monkeypatch.setattr(shared, "written", written)
    rows = spark.createDataFrame([(i, '{"path": "a", "tag": "t", "edits": [{"delete": {"lines": [1, 2]}}]}') for i in range(50)], "req long, body string").coalesce(1)
    symbols = spark.createDataFrame([], "file string, name string, qualified string, kind string, start_line int")
    hunks = requests.compiled(rows, symbols, spark.createDataFrame([], "file string, start int, end int"))[1]
    assert hunks.count() == 50
    assert parts["requests"] >= spark.sparkContext.defaultParallelism
