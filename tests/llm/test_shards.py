"""Shards of the search index as row groups of their own."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sparkloom.llm import lexical


def test_shards_are_row_groups(spark):
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), "id", F.lit(" common")).alias("text"))
    index = lexical.build_index(docs, shard=64)
    groups = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in index.table.inputFiles()]
    assert index.table.count() > 1 and all(g.num_row_groups == g.num_rows for g in groups)
