"""Blocks by size, slices by bytes, and archives in stores that Hadoop names otherwise."""

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import substring_dedup, topk, warc


def test_blocks_of_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "COMPONENTS", 1 << 14)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4096).tolist()) for i in range(30)]
    df = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 10 = 0"), 3).collect()))
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    s = x @ x.T
    expected = [(q, r + 1, j, int(s[q, j])) for q in (0, 10, 20) for r, j in enumerate(sorted((j for j in range(30) if j != q), key=lambda j: (-s[q, j], j))[:3])]
    assert got == expected


def test_slices_by_bytes(spark):
    sizes = [10] * 50 + [5000] * 40 + [40_000] * 40 + [3_000_000] * 20
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(2)
    slices, n_bytes = substring_dedup.sliced(df)
    assert n_bytes == sum(sizes)
    per = slices.groupBy("p").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in per) == len(sizes) and max(r["bytes"] for r in per) <= 1 << 25
    assert slices.select("row").distinct().count() == len(sizes)


@pytest.mark.parametrize(
    ("path", "asked"),
    [
        ("s3a://bucket/a/b", "s3://bucket/a/b"), ("s3n://bucket/a", "s3://bucket/a"), ("wasbs://box@acc.blob.core.windows.net/a", "abfss://box@acc.dfs.core.windows.net/a"),
        ("hdfs://name:9000/a", "hdfs://name:9000/a"), ("file:///a/b", "file:///a/b"), ("/a/b", "/a/b"),
    ],
)
def test_names_of_stores(monkeypatch, path, asked):
    seen = []

    class Stub:
        @staticmethod
        def from_uri(uri):
            seen.append(uri)
            return "fs", "at"

    monkeypatch.setattr(warc.pafs, "FileSystem", Stub)
    assert warc._filesystem(path) == ("fs", "at") and seen == [asked]


def test_other_stores_by_hadoop(monkeypatch):
    monkeypatch.setattr(warc.pafs, "HadoopFileSystem", lambda host, port: (host, port))
    assert warc._filesystem("oss://bucket/a/b") == (("oss://bucket", 0), "/a/b")


def test_local_paths(tmp_path):
    fs, at = warc._filesystem(f"file://{tmp_path}")
    assert isinstance(fs, pafs.LocalFileSystem) and at == str(tmp_path)
