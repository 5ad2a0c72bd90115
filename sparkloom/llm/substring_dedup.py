"""Removal of word windows that also occur in a document with a smaller id, behind a count-min prefilter.

Windows of `width` words are represented by their anchor: the least hash among the window's shorter word grams. Equal
windows have equal anchors, so how many documents hold an anchor is never less than how many hold the window.

1. The documents are written once, cut into slices of some thousand rows, as a table bucketed by slice. What is worked out
   for a slice later comes to its texts by that key, and the texts are not shuffled.
2. Every slice counts its anchors, once a document, and sends them to shards by hash. A shard merges what the slices send into
   a count-min sketch of its own and answers each slice with those of its anchors that are estimated in two documents or
   more; estimates are never too low, so no repeat is lost. The number of shards grows with the corpus, so the sketch as a
   whole does too, while a task holds the sketch of one shard, and neither driver nor broadcast holds any of it.
3. A second pass keeps only windows whose anchor was in the answer and groups them exactly. Neighbouring windows with one
   anchor form a run; equal runs, told by 128-bit hashes, are one class, and only where an anchor has several classes are
   their windows grouped one by one.
4. The covered words of each slice's documents come to their texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, countmin
from . import words as W

#: Words of the gram whose least hash is a window's anchor.
GRAM = 16
#: About so many bytes of text have one anchor.
ANCHOR_BYTES = 110
#: A slice has 2 ** SLICE rows at most, all of one partition of the input and of about one length: texts up to SMALL bytes are
#: together, and of those up to 2 ** i times as long there are 2 ** i times fewer. So it has 32 MB of text, or one longer text.
SLICE = 13
SMALL = 1 << 12
#: Anchors of a shard, of which the sketch has four counters each in every row.
SHARD = 1 << 18
_WORD = W.word_bytes()


class Windows:
    """The windows of a slice of texts: word hashes, valid window starts, their owners and anchors."""

    def __init__(self, column: pa.Array, width: int) -> None:
        raw, offsets = W.column_bytes(column)
        starts, ends = W.spans(raw, offsets, _WORD)
        self.hashes = W.hash_spans(raw, starts, ends)
        self.word_offsets = np.searchsorted(starts, offsets)
        gram = min(GRAM, width)
        n = len(self.hashes) - width + 1
        if n <= 0:
            self.at = self.owner = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        anchor = W.sliding_min(W.window_hashes(self.hashes, gram), width - gram + 1)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(self.word_offsets))
        valid = np.arange(n) + width <= self.word_offsets[1:][owner[:n]]
        self.at = np.flatnonzero(valid)
        self.owner, self.anchor = owner[self.at], anchor[self.at]

    def runs(self) -> np.ndarray:
        """Indexes into at where a run of windows with one owner and one anchor begins."""
        if not len(self.at):
            return self.at
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.owner[1:] != self.owner[:-1])
        return np.flatnonzero(new)


def sliced(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with row, a number of its own for every row, and p, its slice, as a table bucketed by p; and the bytes of text."""
    spark = docs.sparkSession
    n, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    buckets = min(most, max(1, n >> SLICE, n_bytes >> 24))
    size = F.ceil(F.log2(F.greatest(F.octet_length("text"), F.lit(1)) / SMALL)).cast("int")
    size = F.coalesce(F.greatest(F.lit(0), F.least(F.lit(SLICE), size)), F.lit(0))
    rows = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("_size", size)
    rows = rows.withColumn("p", F.expr(f"shiftright(row, {SLICE} - _size) * 32 + _size")).drop("_size")
    path = common.scratch(spark, "slices")
    name = path.rpartition("/")[2].replace("-", "_")
    rows.write.bucketBy(buckets, "p").option("path", path).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    # The catalog only has to tell of the buckets once: the files under path are not the table's own and stay.
    spark.sql(f"drop table `{name}`")
    return table, n_bytes


def repeated_anchors(slices: DataFrame, width: int, n_bytes: int, per_shard: int = SHARD) -> DataFrame:
    """(p, anchors): in binaries of 64-bit integers, the anchors of each slice that are estimated in two documents or more.

    slices has p and text.
    """
    shards = n_bytes // ANCHOR_BYTES // per_shard + 1
    counters = countmin.power(4 * per_shard)
    request = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("p", T.LongType()), T.StructField("n_twice", T.IntegerType()), T.StructField("anchors", T.BinaryType())])
    answer = T.StructType([T.StructField("p", T.LongType()), T.StructField("anchors", T.BinaryType())])

    def asked(p: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, count = np.unique(np.concatenate(held), return_counts=True)
        shard = (W.mix(keys, 25) % W.U64(shards)).astype(np.int32)
        order = np.lexsort((count < 2, shard))  # by shard, those of several documents first
        keys, count, shard = keys[order], count[order], shard[order]
        ids, first = np.unique(shard, return_index=True)
        parts = list(zip(first.tolist(), np.append(first[1:], len(keys)).tolist(), strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int32()), pa.array([p] * len(ids), pa.int64()), pa.array([int((count[a:b] > 1).sum()) for a, b in parts], pa.int32()), pa.array([keys[a:b].tobytes() for a, b in parts], pa.binary())],
            request.names,
        )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part in W.batches(batch, "text"):
                w = Windows(part.column("text"), width)
                first = w.runs()
                keys, owner = w.anchor[first], w.owner[first]
                _, kept = np.unique(keys ^ W.mix(owner.astype(np.uint64), 9), return_index=True)  # once a document
                keys, mine = keys[kept], part.column("p").to_numpy()[owner[kept]]
                for p in np.unique(mine).tolist():
                    if p != now and held:
                        yield from asked(now, held)
                        held = []
                    now = p
                    held.append(keys[mine == p])
        if held:
            yield from asked(now, held)

    def answered(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        keys = [np.frombuffer(x, np.uint64) for _, _, x in rows]
        every = np.concatenate(keys)
        weight = np.concatenate([np.where(np.arange(len(k)) < n, 2, 1) for k, (_, n, _) in zip(keys, rows, strict=True)])
        again = countmin.twice(every, weight, counters)
        ends = np.cumsum(list(map(len, keys)))
        made = [k[hit].tobytes() for k, hit in zip(keys, np.split(again, ends[:-1]), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in rows], pa.int64()), pa.array(made, pa.binary())], answer.names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now and rows:
                    yield answered(rows)
                    rows = []
                now = shard
                rows.append(tuple(row))
        if rows:
            yield answered(rows)

    requests = slices.select("p", "text").mapInArrow(ask, request)
    return requests.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, answer).filter(F.octet_length("anchors") > 0)


def by_slice(slices: DataFrame, other: DataFrame, fn: Callable[[pa.RecordBatch, pa.Table], pa.RecordBatch | None], schema: T.StructType) -> DataFrame:
    """fn of some rows of a slice and all rows of other(p, ...) that belong to it, for all slices."""

    def run(rows: pa.Table, mine: pa.Table) -> pa.Table:
        made = [fn(part, mine) for batch in rows.to_batches() for part in W.batches(batch, "text")]
        return pa.Table.from_batches([m for m in made if m is not None], arrow_schema(schema))

    return slices.groupBy("p").cogroup(other.groupBy("p")).applyInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def candidate_runs(slices: DataFrame, width: int, anchors: DataFrame) -> DataFrame:
    """Runs of windows whose anchor is among anchors(p, anchors) of their slice; slices has p, row, doc_id and text."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("p", T.LongType()), T.StructField("row", T.LongType()), T.StructField("start", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("anchor", "r1", "r2")]
        + [T.StructField("n", T.IntegerType()), T.StructField("hashes", T.ArrayType(T.LongType(), False))]
    )
    shape = arrow_schema(schema)

    def run(part: pa.RecordBatch, mine: pa.Table) -> pa.RecordBatch | None:
        if not mine.num_rows:
            return None
        wanted = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in mine.column("anchors").to_pylist()]))
        w = Windows(part.column("text"), width)
        first = w.runs()
        if not len(first):
            return None
        n = np.diff(np.append(first, len(w.at)))
        key = w.anchor[first]
        at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        keep = wanted[at] == key
        mask = np.repeat(keep, n)
        first, n = first[keep], n[keep]
        at = w.at[first]
        own = w.owner[first]
        r = [W.range_hashes(w.hashes, at, at + n + width - 1, k).view(np.int64) for k in (0, 1)]
        where = w.at[mask]
        flat = W.range_hashes(w.hashes, where, where + width).view(np.int64)
        offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
        owned = [part.column(c).take(pa.array(own)) for c in ("doc_id", "p", "row")]
        starts = pa.array((at - w.word_offsets[own]).astype(np.int32))
        hashes = pa.ListArray.from_arrays(offsets, pa.array(flat)).cast(shape.field("hashes").type)
        return pa.RecordBatch.from_arrays([*owned, starts, pa.array(w.anchor[first].view(np.int64)), pa.array(r[0]), pa.array(r[1]), pa.array(n.astype(np.int32)), hashes], schema=shape)

    return by_slice(slices, anchors, run, schema)


def covered_spans(slices: DataFrame, n_bytes: int, width: int = 50, per_shard: int = SHARD) -> DataFrame:
    """(p, row, s, e): spans [s, e) of words that windows cover which also start in a document with a smaller id."""
    told = slices.filter("doc_id is not null and text is not null").select("p", "row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = common.written(candidate_runs(told, width, repeated_anchors(told, width, n_bytes, per_shard)), "runs")

    key = ["anchor", "r1", "r2", "n"]
    classes = common.written(runs.groupBy(*key).agg(F.min("doc_id").alias("m"), F.first("hashes").alias("hashes")), "classes")
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("anchor")
    windows = classes.join(several, "anchor", "left_semi").select(*key, "m", F.posexplode("hashes").alias("p", "w"))
    least = windows.groupBy("anchor", "w").agg(F.min("m").alias("wm"), F.max("m").alias("most")).filter("wm < most").drop("most")
    partly = windows.join(least, ["anchor", "w"]).filter("wm < m").groupBy(*key).agg(F.collect_list("p").alias("ps"))
    resolved = classes.drop("hashes").join(partly, key, "left")
    spans = F.when(F.col("doc_id") > F.col("m"), F.array(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n") + width - 1).alias("e")))).otherwise(
        F.transform("ps", lambda p: F.struct((F.col("start") + p).alias("s"), (F.col("start") + p + width).alias("e")))
    )
    found = runs.drop("hashes").join(resolved, key).filter((F.col("doc_id") > F.col("m")) | F.col("ps").isNotNull())
    return found.select("p", "row", F.explode(spans).alias("x")).select("p", "row", "x.s", "x.e")


def _spans_of(part: pa.RecordBatch, mine: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """For each row its spans' starts and ends, None where it has none."""
    row = mine.column("row").to_numpy()
    order = np.argsort(row, kind="stable")
    row, s, e = row[order], mine.column("s").to_numpy()[order], mine.column("e").to_numpy()[order]
    asked = part.column("row").to_numpy()
    for a, b in zip(np.searchsorted(row, asked).tolist(), np.searchsorted(row, asked, "right").tolist(), strict=True):
        yield (s[a:b], e[a:b]) if b > a else None


def cut(text: str | None, spans: tuple[np.ndarray, np.ndarray] | None) -> tuple[list[bytes], int]:
    """The words kept, and how many are removed."""
    words = (text or "").encode().split()
    if spans is None:
        return words, 0
    gone = np.zeros(len(words) + 1, np.int32)
    np.add.at(gone, spans[0], 1)
    np.add.at(gone, spans[1], -1)
    gone = (np.cumsum(gone[:-1]) > 0).tolist()
    kept = [w for w, g in zip(words, gone, strict=True) if not g]
    return kept, len(words) - len(kept)


def substring_digest(docs: DataFrame, width: int = 50, per_shard: int = SHARD) -> DataFrame:
    """The contract's columns for every row of docs(doc_id, text).

    A null or empty text has no words; a null id loses nothing and removes nothing elsewhere; rows that repeat an id with its
    text lose the same words. Texts of any length are read whole; other columns play no part; an empty table gives an empty table.
    """
    slices, n_bytes = sliced(docs.select("doc_id", "text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    shape = arrow_schema(schema)

    def run(part: pa.RecordBatch, mine: pa.Table) -> pa.RecordBatch:
        n, gone, sha = [], [], []
        for text, spans in zip(part.column("text").to_pylist(), _spans_of(part, mine), strict=True):
            kept, removed = cut(text, spans)
            n.append(len(kept) + removed)
            gone.append(removed)
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], schema=shape)

    return by_slice(slices, covered_spans(slices, n_bytes, width, per_shard), run, schema)


def deduplicate_passages(docs: DataFrame, width: int = 50, per_shard: int = SHARD) -> DataFrame:
    """docs without the words that repeat a passage of a document with a smaller id; texts that lose nothing stay as they are.

    A text that loses words becomes its kept words joined by one space. A null text or a null id loses nothing, and a
    row with a null id removes nothing elsewhere. Rows that repeat one id with one text lose the same words. Other
    columns of any name pass through, except n_chars, which follows the text. An empty table gives an empty table.
    """
    rows, names = common.shielded(docs, "doc_id", "text")
    inner = list(names.values())
    slices, n_bytes = sliced(rows)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    shape = arrow_schema(schema)

    def run(part: pa.RecordBatch, mine: pa.Table) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        for i, spans in enumerate(_spans_of(part, mine)):
            if spans is not None:
                texts[i] = b" ".join(cut(texts[i], spans)[0]).decode()
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in inner], schema=shape)

    out = common.unshielded(by_slice(slices, covered_spans(slices, n_bytes, width, per_shard), run, schema), names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
