"""Near-duplicates by min-max hashing.

Each of 64 permutations of the shingle hashes gives two signature values, its minimum and its maximum, so 128 values
cost 64 evaluations; both agree between two sets with the probability of their Jaccard similarity. 32 bands of four
values (two minima, two maxima) make pairs of similarity 0.8 meet with a probability above 1 - 1e-7.

1. Equal shingle sets are one class, told by a 128-bit fingerprint; only its smallest document goes on.
2. In each bucket of a band every member is compared with a pivot, on full sets, as a stream. The pivot is the member
   that shares buckets with the most others, which in a group of edited copies is the one the others were copied from.
3. After connected components, members outside their pivot's component are still open: towards every member that meets
   the pivot. They are compared in blocks of some 64 open members, past which the others are streamed; only links come
   out. Exact bounds leave out what cannot be linked: the distances to the pivot (the Jaccard distance is a metric) and
   how many shingles of a document occur in no other one here, by a count-min sketch, whose counts are never too low.
   Members of the pivot's component need no comparison with each other. So no pair that a bucket holds is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, components, countmin
from . import words as W

PERMUTATIONS = 64
BANDS = 32
_WORD = W.word_bytes()
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_A = W.mix(np.arange(PERMUTATIONS, dtype=np.uint64), 40) | W.U64(1)
_B = W.mix(np.arange(PERMUTATIONS, dtype=np.uint64), 41)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text; fewer than k words make one shingle, none make none."""
    raw, offsets = W.column_bytes(column)
    starts, ends = W.spans(raw, offsets, _WORD)
    hashes = W.hash_spans(raw, starts, ends, _LOWER)
    at = np.searchsorted(starts, offsets)
    windows = W.window_hashes(hashes, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(windows[a : b - k + 1]))
        else:
            out.append(W.range_hashes(hashes[a:b], np.array([0]), np.array([b - a])) if b > a else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima and maxima under all permutations: 2 x PERMUTATIONS."""
    low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), 4096):
        x = shingles[None, i : i + 4096] * _A[:, None] + _B[:, None]
        low, high = np.minimum(low, x.min(1)), np.maximum(high, x.max(1))
    return np.stack([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band: two minima and two maxima each."""
    per = PERMUTATIONS // BANDS
    values = sig.reshape(2, BANDS, per).transpose(1, 0, 2).reshape(BANDS, 2 * per)
    key = W.mix(np.arange(BANDS, dtype=np.uint64), 43)
    for j in range(2 * per):
        key = W.mix(key ^ values[:, j], 44)
    return key


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, rk, n, f1, f2, bands) for every row of docs(doc_id, rk, text); n is the size of the shingle set, f1 and f2 its fingerprint."""
    kind = pa.list_(pa.field("element", pa.int64(), False))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "rk", "n", "f1", "f2")] + [T.StructField("bands", T.ArrayType(T.LongType(), False))])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in W.batches(batch, "text"):
            sets = shingle_sets(part.column("text"), k)
            f = [np.array([W.mix(s, seed).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for seed in (45, 46)]
            bands = [band_keys(signature(s)).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            at = pa.array(np.cumsum([0, *map(len, bands)], dtype=np.int32))
            made = pa.ListArray.from_arrays(at, pa.array(np.concatenate(bands))).cast(kind)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rk"), pa.array([len(s) for s in sets], pa.int64()), pa.array(f[0]), pa.array(f[1]), made], schema.names)

    return common.arrow_map(docs, run, schema)


def compare(docs: DataFrame, pairs: DataFrame, k: int, share: int = 64) -> DataFrame:
    """(a, b, inter, total) for every pair (a, b), on full shingle sets; a written table.

    The members of a pair's group are dealt to blocks of about `share`; each block gets the text of a and streams the
    texts of its b's past it, so a hot a is spread and memory holds one set and one batch.
    """
    count = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    dealt = pairs.join(count, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / share)).cast("int").alias("salt"))
    dealt = common.written(dealt, "dealt")
    wanted = dealt.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("role")).union(dealt.select(F.col("a"), "a", "salt", F.lit(0)).distinct())
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "inter", "total")])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = np.zeros(0, np.uint64), None
        for batch in parts:
            for part in W.batches(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                out: list[tuple[int, int, int, int]] = []
                for s, a, salt, role, b in zip(sets, *(part.column(c).to_pylist() for c in ("a", "salt", "role", "doc_id")), strict=True):
                    if role == 0:
                        held, block = s, (a, salt)
                    else:
                        assert block == (a, salt)
                        inter = len(np.intersect1d(held, s, assume_unique=True))
                        out.append((a, b, inter, len(held) + len(s) - inter))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema.names)

    # The sort puts a's text before those of its block.
    out = common.written(texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, schema), "compared")
    common.dropped(dealt)
    return out


def shared_sizes(docs: DataFrame, k: int, bits) -> DataFrame:
    """(doc_id, v): at least as many as the shingles of a document that another one has, by the bits of a sketch (a broadcast variable)."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("v", T.LongType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in W.batches(batch, "text"):
            v = [int(countmin.repeated(s, bits.value).sum()) for s in shingle_sets(part.column("text"), k)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(v, pa.int64())], schema.names)

    return common.arrow_map(docs, run, schema)


def overlaps(block: tuple[np.ndarray, np.ndarray, int], shingles: np.ndarray) -> np.ndarray:
    """How many shingles each set of a block shares with one set; block is its sets' sorted hashes, their owners and the number of sets."""
    values, owners, n = block
    at = np.searchsorted(values, shingles)
    end = np.searchsorted(values, shingles, "right")
    count = end - at
    hit = count > 0
    at, count = at[hit], count[hit]
    where = np.repeat(at - np.cumsum(np.append(0, count[:-1])), count) + np.arange(count.sum())
    return np.bincount(owners[where], minlength=n)


def open_links(members: DataFrame, comp: DataFrame, docs: DataFrame, k: int, percent: int, share: int = 64, steps: int = 50) -> DataFrame | None:
    """(a, b): links between members of a pivot of which one at least is outside its component.

    members is (a, b, n, d): b's set size and distance to the pivot a. Open members are dealt to blocks by pivot, distance
    (in 1 / steps) and a salt; a block's texts come first, then those of all members at a distance that may be linked.
    """
    named = members.join(comp.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left").join(comp.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left")
    named = common.written(named.select("a", "b", "n", "d", (F.coalesce("cb", "b") != F.coalesce("ca", "a")).alias("open")), "named")
    near = named.join(named.filter("open").select("a").distinct(), "a", "left_semi")
    total = near.select("b", "n").distinct().agg(F.sum("n")).first()[0]
    if not total:
        common.dropped(named)
        return None
    ids = near.select(F.col("b").alias("doc_id")).distinct()
    text = common.written(docs.join(ids.hint("merge"), "doc_id", "left_semi"), "open-text")
    # A document alone with more than 100 - percent of its shingles is linked with nothing here.
    sketch = countmin.repeated_bits(text.select("text"), lambda part: np.concatenate(shingle_sets(part.column("text"), k)), countmin.width_for(total))
    bits = docs.sparkSession.sparkContext.broadcast(sketch)
    near = near.join(shared_sizes(text, k, bits).withColumnRenamed("doc_id", "b"), "b")
    near = common.written(near.filter(F.expr(f"100 * v >= {percent} * n")).select("a", "b", "d", "open"), "open")
    bits.destroy()
    common.dropped(named)
    step = F.floor(F.col("d") * steps).cast("int").alias("step")
    sizes = near.filter("open").groupBy("a", step).agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("salts"))
    first = near.filter("open").withColumn("step", step).join(sizes, ["a", "step"]).select(F.col("b").alias("doc_id"), "a", "step", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("role"))
    reach = 1 - percent / 100 + 1e-9
    then = near.join(sizes, "a").filter((F.col("d") >= F.col("step") / steps - reach) & (F.col("d") <= (F.col("step") + 1) / steps + reach))
    then = then.select(F.col("b").alias("doc_id"), "a", "step", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("role"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b")])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sets = None, [], []
        table = sizes_ = None
        for batch in parts:
            for part in W.batches(batch, "text"):
                out: list[tuple[int, int]] = []
                rows = zip(shingle_sets(part.column("text"), k), *(part.column(c).to_pylist() for c in ("a", "step", "salt", "role", "doc_id")), strict=True)
                for s, a, step_, salt, role, b in rows:
                    if (a, step_, salt) != block:
                        block, ids, sets, table = (a, step_, salt), [], [], None
                    if role == 0:
                        ids.append(b)
                        sets.append(s)
                        continue
                    if table is None:
                        values = np.concatenate(sets)
                        order = np.argsort(values, kind="stable")
                        table = values[order], np.repeat(np.arange(len(sets)), list(map(len, sets)))[order], len(sets)
                        sizes_ = np.array(list(map(len, sets)))
                    inter = overlaps(table, s)
                    out += [(min(b, ids[i]), max(b, ids[i])) for i in np.flatnonzero(100 * inter >= percent * (sizes_ + len(s) - inter)).tolist() if ids[i] != b]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema.names)

    texts = text.select("doc_id", "text").join(first.union(then).hint("merge"), "doc_id")
    links = common.written(texts.repartition("a", "step", "salt").sortWithinPartitions("a", "step", "salt", "role").mapInArrow(run, schema), "open-links")
    common.dropped(text, near)
    return links


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, rk, n, component) for every row of docs(doc_id, text); rk is a hash of the row's text.

    Links documents whose shingle sets have 100 * intersection >= percent * union; component is the smallest id reachable.
    A row without words, or with a null id, is linked with nothing. Rows that share an id and a text are one document; if
    rows share an id but not the text, every text is a document of its own in its classes, compared by any text under the
    id. Very long texts are hashed a slice at a time. Empty tables give empty tables; further columns play no part.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rk"), "text")
    rows = common.written(signatures(docs, k), "signatures")
    key = ["n", "f1", "f2"]
    full = rows.filter("n > 0 and doc_id is not null")
    classes = common.written(full.groupBy(*key).agg(F.min(F.struct("doc_id", "bands")).alias("x")).select(*key, "x.*"), "classes")
    members = classes.select(F.col("doc_id").alias("b"), "n", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    buckets = common.written(members.join(sizes, "band"), "buckets")
    central = buckets.join(buckets.groupBy("b").agg(F.sum("c").alias("score")), "b")
    pivots = central.groupBy("band").agg(F.max(F.struct("score", (-F.col("b")).alias("m"))).alias("p")).select("band", (-F.col("p.m")).alias("a"))
    pairs = common.written(buckets.join(pivots, "band").filter("a <> b").select("a", "b", "n").distinct(), "pairs")
    common.dropped(buckets)

    ids = pairs.select(F.col("b").alias("doc_id")).union(pairs.select("a")).distinct()
    # Texts are always sent by a merge join: whether the ids would fit a broadcast depends on the corpus.
    text = common.written(docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi"), "candidates")
    near = F.expr(f"100 * inter >= {percent} * total")
    links = compare(text, pairs.select("a", "b"), k)
    comp = components.components(links.filter(near).select("a", "b"))
    distance = (1 - F.col("inter") / F.col("total")).alias("d")
    more = open_links(pairs.join(links.select("a", "b", distance), ["a", "b"]), comp, text, k, percent)
    common.dropped(pairs, text, links)
    if more is not None:
        comp = components.components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        common.dropped(more)

    of_class = classes.select(*key, F.col("doc_id").alias("node")).join(comp, "node", "left").select(*key, F.coalesce("component", "node").alias("component"))
    linked = full.select("doc_id", "rk", *key).join(of_class, key).select("doc_id", "rk", "n", "component")
    alone = rows.filter("n = 0 or doc_id is null").select("doc_id", "rk", "n", F.col("doc_id").alias("component"))
    return linked.union(alone)


def minhash_digest(docs: DataFrame, k: int = 2) -> DataFrame:
    """The contract's columns for every row of docs(doc_id, text).

    A null or empty text, or one without words, has n_shingles 0 and is its own component; a null id has a null component
    and is kept; repeated rows share a component. Long texts, empty tables and other columns are as in near_duplicates().
    """
    rows = near_duplicates(docs, k)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs without the rows that are linked, directly or through others, to a document with a smaller id.

    Of rows that share an id each goes or stays by its own text. Rows with null ids or without words stay, as do all
    repeats of a row that stays; columns of any name pass through.
    """
    rows, names = common.shielded(docs, "doc_id", "text")
    gone = near_duplicates(rows, k).filter("doc_id <> component").select(F.col("doc_id").alias("gone_id"), "rk").distinct()
    match = (F.col("doc_id").cast("long") == F.col("gone_id")) & (F.xxhash64("text") == F.col("rk"))
    return common.unshielded(rows.join(gone.hint("merge"), match, "left_anti"), names)
