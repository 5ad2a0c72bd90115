"""Ranked lexical search over an index of document shards: CSR postings with integer impacts, read term at a time.

A shard is a run of documents of one input partition with some MB of text. Its row in the index holds the sorted 64-bit
hashes of its terms, where each term's postings start, and the postings: the document's place in the shard and its impact,
(1000000000 * tf) div (1000 * tf + 8 * m), worked out once when the index is built. What is left for a search is one
weight for each term of the query, which a first pass over the dictionaries gives (how many documents hold it).

A search reads every shard once for a block of queries: for each query a dense numpy accumulator over the shard's documents gets
weight * impact of every posting, term at a time. The k-th best score of a shard comes from a partition; all documents with a better
one and as many of the equal ones as there is room for, by id, are kept. Tasks merge their shards' lists, and two
windows, the first over groups of tasks, merge those of tasks. No posting is shuffled.

Two different terms share a hash with a probability of 2^-64 a pair, and only terms of queries matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import words as W

#: Bytes of text of a shard, and of the queries of a block; one document or one query may be longer.
SHARD = 1 << 23
QUERIES = 1 << 22
_TERM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TERM[_a:_b] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_INTS = T.ArrayType(T.IntegerType(), False)
_LONGS = T.ArrayType(T.LongType(), False)


@dataclass
class Index:
    """table: a row a shard; documents: those with a term; terms: of all documents, with repeats."""

    table: DataFrame
    documents: int
    terms: int


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all terms of the texts, and the len + 1 places where each text's terms begin."""
    raw, offsets = W.column_bytes(column)
    starts, ends = W.spans(raw, offsets, _TERM)
    return W.hash_spans(raw, starts, ends, _LOWER), np.searchsorted(starts, offsets)


def totals(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms all have."""
    schema = T.StructType([T.StructField("documents", T.LongType()), T.StructField("terms", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = every = 0
        for batch in batches:
            for part in W.batches(batch, "text"):
                raw, offsets = W.column_bytes(part.column("text"))
                n = np.diff(np.searchsorted(W.spans(raw, offsets, _TERM)[0], offsets))
                some, every = some + int((n > 0).sum()), every + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([every])], schema.names)

    got = docs.select("text").mapInArrow(run, schema).agg(F.sum("documents"), F.sum("terms")).first()
    return got[0] or 0, got[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 8 * m) with m = 100 - 90 + ((90 * n * documents) div terms), in integers."""
    if 90 * int(n.max(initial=0)) * documents < 2**63:
        m = 10 + (90 * n * documents) // max(1, terms)
    else:
        m = np.array([10 + 90 * int(x) * documents // terms for x in n], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def build_index(docs: DataFrame, shard: int = SHARD) -> Index:
    """The index of all rows of docs(doc_id, text), as a written table.

    Every row with an id is a document, repeated rows too; rows without an id, a text or a term are not indexed and do not
    count. Texts are read whole; a text longer than a shard is a shard of its own. Other columns play no part.
    """
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    documents, terms = totals(docs)
    schema = T.StructType([T.StructField("ids", _LONGS), T.StructField("terms", _LONGS), T.StructField("starts", _INTS), T.StructField("docs", _INTS), T.StructField("impacts", _INTS)])

    def shut(ids: list[np.ndarray], hashes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        n = np.concatenate(counts)
        owner = np.repeat(np.arange(len(n)), n)
        every = np.concatenate(hashes)
        order = np.lexsort((owner, every))
        term, owner = every[order], owner[order]
        new = np.append(True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1]))
        first = np.flatnonzero(new)
        tf = np.diff(np.append(first, len(term)))
        term, owner = term[first], owner[first]
        words, at = np.unique(term, return_index=True)
        lists = words.view(np.int64), np.append(at, len(term)).astype(np.int32), owner.astype(np.int32), impacts(tf, n[owner], documents, terms).astype(np.int32)
        rows = [pa.array([np.concatenate(ids)], pa.list_(pa.field("element", pa.int64(), False)))]
        for values in lists:
            rows.append(pa.array([values], pa.list_(pa.field("element", pa.from_numpy_dtype(values.dtype), False))))
        return pa.RecordBatch.from_arrays(rows, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, counts, size = [], [], [], 0
        for batch in batches:
            for part in W.batches(batch, "text", min(shard, 1 << 21)):
                found, at = terms_of(part.column("text"))
                n = np.diff(at)
                some = n > 0
                if not some.any():
                    continue
                ids.append(part.column("doc_id").to_numpy()[some])
                hashes.append(found)
                counts.append(n[some])
                size += len(W.column_bytes(part.column("text"))[0])
                if size >= shard:
                    yield shut(ids, hashes, counts)
                    ids, hashes, counts, size = [], [], [], 0
        if size:
            yield shut(ids, hashes, counts)

    # A shard is a row group of its own: otherwise the writer holds a hundred of them before it looks at their size, and the
    # reader, which takes up to 4096 rows at once, all of a file.
    return Index(common.written(docs.mapInArrow(run, schema), "index", **{"parquet.block.row.count.limit": "1"}), documents, terms)


class _Block:
    """Some queries: the sorted hashes of all their terms, and for each query which of them it has."""

    def __init__(self, texts: list[str | None]) -> None:
        hashes, at = terms_of(pa.array(texts, pa.large_string()))
        own = [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.terms = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]))
        self.of = [np.searchsorted(self.terms, x) for x in own]
        self.weights = np.zeros(len(self.terms), np.int64)


def _places(block: _Block, terms: np.ndarray) -> np.ndarray:
    """Where each of the block's terms is among a shard's, -1 if it is not there."""
    if not len(terms):
        return np.full(len(block.terms), -1)
    at = np.minimum(np.searchsorted(terms, block.terms), len(terms) - 1)
    return np.where(terms[at] == block.terms, at, -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores above 0, equal ones by the smaller id; all if there are fewer."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        edge = scores[some[np.argpartition(scores[some], len(some) - k)[len(some) - k]]]
        some = some[scores[some] >= edge]  # with all that are equal to the k-th
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _rows(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in batch.schema.names}


def _weights(index: Index, block: _Block) -> np.ndarray:
    """floor(1000 * ln((2 * documents + 2) / (2 * df + 1))) for each term of a block; 0 for terms that no document holds."""
    shared = index.table.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("df", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shared.value.terms), np.int64)
        for batch in batches:
            for row in _rows(batch):
                at = _places(shared.value, row["terms"].view(np.uint64))
                df += np.where(at < 0, 0, np.diff(row["starts"])[np.maximum(at, 0)] if len(row["terms"]) else 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(df[some])], schema.names)

    out = np.zeros(len(block.terms), np.int64)
    for row in index.table.select("terms", "starts").mapInArrow(run, schema).groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the block
        out[row["term"]] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * row["df"] + 1)))
    shared.destroy()
    return out


def _search(index: Index, block: _Block, k: int) -> DataFrame:
    """(query, doc_id, score): for each task the best k of its shards."""
    shared = index.table.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in mine.of]
        for batch in batches:
            for row in _rows(batch):
                at = _places(mine, row["terms"].view(np.uint64))
                starts, docs, impact, ids = row["starts"], row["docs"], row["impacts"].astype(np.int64), row["ids"]
                for q, terms in enumerate(mine.of):
                    total = np.zeros(len(ids), np.int64)
                    for t in terms[at[terms] >= 0].tolist():
                        a, b = starts[at[t]], starts[at[t] + 1]
                        total[docs[a:b]] += mine.weights[t] * impact[a:b]  # a term has a document once
                    top = best(total, ids, k)
                    if len(top):
                        had = found[q]
                        score, doc = np.append(had[0], total[top]), np.append(had[1], ids[top])
                        top = best(score, doc, k)
                        found[q] = score[top], doc[top]
        n = [len(s) for s, _ in found]
        rows = [pa.array(np.repeat(np.arange(len(n)), n), pa.int32()), pa.array(np.concatenate([d for _, d in found])), pa.array(np.concatenate([s for s, _ in found]))]
        yield pa.RecordBatch.from_arrays(rows, schema.names)

    return index.table.mapInArrow(run, schema)


def search(index: Index, queries: DataFrame, k: int = 10, limit: int = QUERIES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every row of queries(item_id, text), best first.

    Scores are above 0; equal ones go by the smaller doc_id. A query counts each of its terms once; without a term that a
    document holds it has no rows, and so has a null text. Rows that repeat an id and a text are one query; rows with a null id
    take no part. Queries are read in blocks of about `limit` bytes, so what is broadcast is bounded by it and the longest
    query; each block is one pass over the index.
    """
    spark = index.table.sparkSession
    rows = queries.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = 1
    while True:  # until no block with several queries is above the limit
        number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block")
        size = F.sum(F.octet_length("text").cast("long") + 64)
        largest = rows.groupBy(number).agg(size.alias("size"), F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.max("size")).first()[0]
        if (largest or 0) <= limit:
            break
        blocks *= 2
    cut = common.written(rows.withColumn("block", number), "queries") if blocks > 1 else rows
    out = None
    for b in range(blocks):
        mine = (cut.filter(F.col("block") == b).drop("block") if blocks > 1 else cut).orderBy("item_id", "text").collect()  # at most `limit` bytes
        if not mine:
            continue
        block = _Block([r["text"] for r in mine])
        block.weights = _weights(index, block)
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], "query int, item_id long")
        group = F.pmod(F.spark_partition_id(), F.lit(256)).alias("part")
        parts = _search(index, block, k).select("*", group)
        order = (F.desc("score"), "doc_id")
        some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).filter(F.col("rank") <= k).drop("rank", "part")
        top = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
        top = top.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")
        out = top if out is None else out.union(top)
    common.dropped(cut)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def ranked_digest(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The contract's columns: the k best rows of docs(doc_id, text) for every row of items(item_id, text). Odd rows are as in
    build_index() and search(); an empty table on either side gives an empty table."""
    return search(build_index(docs), items, k)
