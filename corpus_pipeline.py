"""A corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages and packing, one stage after the other.

Each stage takes all its predecessor kept. All but the last return the columns of documents; their order is not kept.
Nulls: a null text fails the quality rules, so it goes in the first stage; other nulls pass through. Rows that repeat an
id with its text are one document, which near-duplicates keep or drop together. Texts of any length are read whole by every
stage. Further columns of documents, whatever their names, pass through all stages but the last; an empty table gives an
empty table with the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common, minhash, packing, quality, substring_dedup, toxicity

CAPACITIES = packing.Capacities(tokens=1024, documents=1024, attention=1024 * 1024)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    return quality.keep_good(docs, quality.fit(docs, _labels(spark, sf_dir)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of their language go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return minhash.keep_one(docs, k=5)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word passages that a document with a smaller id holds too go."""
    return substring_dedup.deduplicate_passages(docs, 50)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the sequence and the offset each is packed to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITIES, ranks=ranks)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicates_stage),
    ("repeated passages", passages_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the learned stages nor the tokens; the tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written as Parquet and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        common.dropped(before)  # a stage's table, once the next one is written; the input is no such table
    return STAGES[-1][1](spark, docs, sf_dir)
