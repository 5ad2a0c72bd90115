"""Jaccard join of word n-gram sets by prefix filtering under several global orders.

Of two sets with a similarity of t or more, each has in its first n - ceil(t n) + 1 tokens one that the other has in its first
ones, whatever global order both are sorted by. So a candidate pair must share a token of its prefixes under every one of ORDERS
orders, and the candidates of the orders are intersected before any pair is verified on full sets.

1. Equal sets are one class, told by a 128-bit fingerprint; one document stands for it from here on.
2. The orders put rare tokens first. Slices of the corpus send their shingles to shards by hash, which count them and answer
   with a frequency class (a power of four) for those in two sets or more. Within a class each order goes by a hash of its
   own. Tokens of one set alone come first in every order and are shared with nobody: a set whose prefix is made of
   them links with nothing and is done with here. Two shingles may share a counter; then they count as more frequent.
3. What is left of the prefixes makes buckets, one a token and order. A set without company in any one of the orders goes. Each
   bucket's members are paired with its pivot, the member that meets most others; pairs found under all orders are verified.
4. Members outside the component of a pivot they meet are compared with all that meet it, in blocks past which the others are
   streamed: first the prefixes under all orders, then full sets; only links come out. Sets whose lone tokens together are too
   many for the similarity are not sent. So every link of different components that the filters let through is found.

Memory holds a block or a slice of texts; no bucket is gathered, capped or turned into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, components, minhash
from . import substring_dedup as S
from . import words as W

ORDERS = 3
#: Shingles of a shard, and bytes of text for each shingle, about.
SHARD = 1 << 20
SHINGLE_BYTES = 6
_LONGS = T.ArrayType(T.LongType(), False)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def counters(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The counter of each shingle: its shard in the upper half, 32 bits of hash in the lower one."""
    key = W.mix(hashes, 50)
    return (key >> W.U64(32)) % W.U64(shards) << W.U64(32) | key & W.U64(0xFFFFFFFF)


def classes_of(counts: np.ndarray) -> np.ndarray:
    """0 for one, else one more than the count's power of four."""
    return np.where(counts < 2, 0, 1 + np.floor(np.log2(np.maximum(counts, 1)) / 2)).astype(np.uint8)


def prefixes(hashes: np.ndarray, classes: np.ndarray, percent: int) -> list[np.ndarray]:
    """For each order the tokens of the prefix that another set has too, sorted by hash."""
    some = classes > 0
    h, c = hashes[some], classes[some]
    room = max(0, prefix_length(len(hashes), percent) - (len(hashes) - len(h)))
    return [np.sort(h[np.lexsort((W.mix(h, 51 + i), c))[:room]]) for i in range(ORDERS)]


def _signatures(slices: DataFrame, k: int) -> DataFrame:
    """(p, row, doc_id, n, f1, f2) for every row: size and fingerprint of its set."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("p", "row", "doc_id", "n", "f1", "f2")])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in W.batches(batch, "text"):
            sets = minhash.shingle_sets(part.column("text"), k)
            f = [pa.array(np.array([W.mix(s, seed).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)) for seed in (45, 46)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("p", "row", "doc_id")), pa.array([len(s) for s in sets], pa.int64()), *f], schema.names)

    return common.arrow_map(slices.select("p", "row", F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def _chosen(rows: pa.Table, wanted: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Row numbers and sets of a slice's wanted rows, some at a time."""
    for batch in rows.to_batches():
        mine = batch.filter(pa.array(np.isin(batch.column("row").to_numpy(), wanted)))
        for part in W.batches(mine, "text"):
            yield part.column("row").to_numpy(), minhash.shingle_sets(part.column("text"), k)


def _frequencies(slices: DataFrame, chosen: DataFrame, k: int, shards: int) -> DataFrame:
    """(p, keys, classes): the counters of each slice's shingles that two sets or more have, and their frequency classes.

    slices has p, row and text; chosen(p, rows) the rows of a slice that count.
    """
    request = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("p", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    answer = T.StructType([T.StructField("p", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("classes", T.BinaryType())])

    def ask(rows: pa.Table, mine: pa.Table) -> pa.Table:
        keys, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if mine.num_rows and rows.num_rows:
            held = [counters(np.concatenate(sets), shards) for _, sets in _chosen(rows, mine.column("rows")[0].values.to_numpy(), k)]
            keys, count = np.unique(np.concatenate([*held, keys]), return_counts=True)
        ids, first = np.unique(keys >> W.U64(32), return_index=True)
        parts = list(zip(first.tolist(), np.append(first, len(keys))[1:].tolist(), strict=True))
        low, few = keys.astype(np.uint32), np.minimum(count, 65535).astype(np.uint16)
        p = [rows.column("p")[0].as_py()] * len(ids) if rows.num_rows else []
        shut = [pa.compress(few[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in parts]
        return pa.table([pa.array(ids.astype(np.int32)), pa.array(p, pa.int64()), pa.array([low[a:b].tobytes() for a, b in parts], pa.binary()), pa.array(shut, pa.binary())], names=request.names)

    def answered(shard: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        keys = [np.frombuffer(x, np.uint32) for _, x, _ in rows]
        counts = [np.frombuffer(pa.decompress(c, 2 * len(x), codec="zstd", asbytes=True), np.uint16) for x, (*_, c) in zip(keys, rows, strict=True)]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        kind = classes_of(np.bincount(at, np.concatenate(counts), len(every)))[at]
        made = [], []
        for x, c in zip(keys, np.split(kind, np.cumsum(list(map(len, keys)))[:-1]), strict=True):
            again = c > 0
            made[0].append((x[again].astype(np.uint64) | W.U64(shard << 32)).tobytes())
            made[1].append(c[again].tobytes())
        return pa.RecordBatch.from_arrays([pa.array([p for p, *_ in rows], pa.int64()), *(pa.array(m, pa.binary()) for m in made)], answer.names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now and rows:
                    yield answered(now, rows)
                    rows = []
                now = shard
                rows.append(tuple(row))
        if rows:
            yield answered(now, rows)

    requests = slices.groupBy("p").cogroup(chosen.groupBy("p")).applyInArrow(ask, request)
    return requests.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, answer).filter(F.octet_length("keys") > 0)


def _survivors(slices: DataFrame, chosen: DataFrame, answers: DataFrame, k: int, percent: int, shards: int) -> DataFrame:
    """(row, n, u, hashes, classes, prefixes) of the chosen rows whose prefix has a token that another set has; u counts lone tokens."""
    fields = [T.StructField(c, T.LongType()) for c in ("row", "n", "u")] + [T.StructField("hashes", _LONGS), T.StructField("classes", T.BinaryType())]
    schema = T.StructType([*fields, *[T.StructField(f"prefix{i}", _LONGS) for i in range(ORDERS)]])
    shape = S.arrow_schema(schema)

    def run(rows: pa.Table, mine: pa.Table) -> pa.Table:
        made = []
        told = [(x["rows"], x["keys"], x["classes"]) for x in mine.to_pylist()] if rows.num_rows else []
        wanted = np.array([r for rows_, *_ in told for r in rows_ or []], np.int64)
        keys = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for _, x, _ in told if x]])
        kinds = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(c, np.uint8) for *_, c in told if c]])
        order = np.argsort(keys)
        keys, kinds = keys[order], kinds[order]
        for numbers, sets in _chosen(rows, wanted, k) if len(keys) else ():
            for row, s in zip(numbers.tolist(), sets, strict=True):
                c = counters(s, shards)
                at = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
                kind = np.where(keys[at] == c, kinds[at], 0).astype(np.uint8)
                u = int((kind == 0).sum())
                if u < prefix_length(len(s), percent):
                    made.append((row, len(s), u, s.view(np.int64), kind.tobytes(), *(x.view(np.int64) for x in prefixes(s, kind, percent))))
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made, strict=True), shape, strict=True)] if made else [pa.array([], f.type) for f in shape], schema=shape)

    nothing = lambda kind: F.lit(None).cast(kind)
    other = answers.select("p", "keys", "classes", nothing("array<bigint>").alias("rows")).union(chosen.select("p", nothing("binary"), nothing("binary"), "rows"))
    return slices.groupBy("p").cogroup(other.groupBy("p")).applyInArrow(run, schema)


def _set(hashes: pa.ListScalar) -> np.ndarray:
    return hashes.values.to_numpy().view(np.uint64)


def _verified(sets: DataFrame, pairs: DataFrame, percent: int, share: int = 64) -> DataFrame:
    """(a, b): the linked ones of pairs(a, b). A block of some `share` pairs holds the set of its a and streams those of its b's."""
    count = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    dealt = common.written(pairs.join(count, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / share)).cast("int").alias("salt")), "dealt")
    wanted = dealt.select(F.col("b").alias("row"), "a", "salt", F.lit(1).alias("role")).union(dealt.select("a", "a", "salt", F.lit(0)).distinct())
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = np.zeros(0, np.uint64), None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for hashes, a, salt, role, b in zip(batch.column("hashes"), *(batch.column(c).to_pylist() for c in ("a", "salt", "role", "row")), strict=True):
                s = _set(hashes)
                if role == 0:
                    held, block = s, (a, salt)
                    continue
                assert block == (a, salt)
                if 100 * min(len(s), len(held)) >= percent * max(len(s), len(held)):
                    inter = len(np.intersect1d(held, s, assume_unique=True))
                    if 100 * inter >= percent * (len(held) + len(s) - inter):
                        out.append((min(a, b), max(a, b)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema.names)

    sent = sets.select("row", "hashes").join(wanted.hint("merge"), "row")
    out = common.written(sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, schema), "star-links")
    common.dropped(dealt)
    return out


class _Table:
    """The tokens of several sets, sorted, for counting how many of them another set has."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.of = values[order], np.repeat(np.arange(len(sets)), list(map(len, sets)))[order], len(sets)

    def shared(self, tokens: np.ndarray) -> np.ndarray:
        return minhash.overlaps(self.of, tokens)


def _open_links(sets: DataFrame, members: DataFrame, comp: DataFrame | None, percent: int, share: int = 64, steps: int = 64) -> DataFrame | None:
    """(a, b): links between sets that meet a pivot of members(a, b), one of which at least is outside the pivot's component.

    Without comp every member counts as outside, and all links of the members come out.
    """
    near = members.select("a", "b").union(members.select("a", "a").distinct())
    if comp is None:
        near = near.withColumn("open", F.lit(True))
    else:
        named = near.join(comp.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left").join(comp.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left")
        near = named.select("a", "b", (F.coalesce("cb", "b") != F.coalesce("ca", "a")).alias("open"))
    # Two sets have at most min(n - u) tokens in common and at least u + u apart: u / (n - u) of both may add up to (1 - t) / t.
    lone = sets.select(F.col("row").alias("b"), (F.col("u") / (F.col("n") - F.col("u"))).alias("r"))
    near = common.written(near.join(lone, "b"), "members")
    step = F.floor(F.col("r") * steps).cast("int").alias("step")
    sizes = near.filter("open").groupBy("a", step).agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("salts"))
    first = near.filter("open").withColumn("step", step).join(sizes, ["a", "step"]).select(F.col("b").alias("row"), "a", "step", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(0).alias("role"))
    reach = (100 - percent) / percent + 1e-9
    then = near.join(sizes, "a").filter(F.col("r") + F.col("step") / steps <= reach)
    then = then.select(F.col("b").alias("row"), "a", "step", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("role"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held, tables, size = None, [], [], None, np.zeros(0, np.int64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for hashes, kinds, a, step_, salt, role, b in zip(batch.column("hashes"), *(batch.column(c).to_pylist() for c in ("classes", "a", "step", "salt", "role", "row")), strict=True):
                s, kind = _set(hashes), np.frombuffer(kinds, np.uint8)
                if (a, step_, salt) != block:
                    block, ids, held, tables = (a, step_, salt), [], [], None
                if role == 0:
                    ids.append(b)
                    held.append((s.copy(), prefixes(s, kind, percent)))
                    continue
                if tables is None:
                    tables = [_Table([x[i] for _, x in held]) for i in range(ORDERS)], _Table([x for x, _ in held])
                    size = np.array([len(x) for x, _ in held])
                able = (100 * np.minimum(size, len(s)) >= percent * np.maximum(size, len(s))) & (np.array(ids) != b)
                for table, tokens in zip(tables[0], prefixes(s, kind, percent), strict=True):
                    if able.any():
                        able &= table.shared(tokens) > 0
                if able.any():
                    inter = tables[1].shared(s)
                    able &= 100 * inter >= percent * (size + len(s) - inter)
                    out += [(min(b, ids[i]), max(b, ids[i])) for i in np.flatnonzero(able).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema.names)

    sent = sets.select("row", "hashes", "classes").join(first.union(then).hint("merge"), "row")
    out = common.written(sent.repartition("a", "step", "salt").sortWithinPartitions("a", "step", "salt", "role").mapInArrow(run, schema), "open-links")
    common.dropped(near)
    return out


def _candidates(sets: DataFrame) -> DataFrame:
    """(a, b, orders): members and the pivots they meet; bit i of orders tells that they meet under order i."""
    tokens = sets.select("row", F.posexplode(F.array(*[f"prefix{i}" for i in range(ORDERS)])).alias("o", "ts")).select("row", "o", F.explode("ts").alias("t"))
    sizes = tokens.groupBy("o", "t").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    buckets = common.written(tokens.join(sizes, ["o", "t"]), "buckets")
    alive = buckets.groupBy("row").agg(F.sum("c").alias("score"), F.bit_or(F.expr("shiftleft(1, o)")).alias("orders")).filter(F.col("orders") == (1 << ORDERS) - 1).drop("orders")
    met = buckets.select("row", "o", "t").join(alive, "row")
    pivots = met.groupBy("o", "t").agg(F.max(F.struct("score", (-F.col("row")).alias("m"))).alias("x")).select("o", "t", (-F.col("x.m")).alias("a"))
    pairs = met.join(pivots, ["o", "t"]).filter("a <> row").groupBy("a", F.col("row").alias("b")).agg(F.bit_or(F.expr("shiftleft(1, o)")).alias("orders"))
    out = common.written(pairs, "pairs")
    common.dropped(buckets)
    return out


def _classes(rows: DataFrame) -> DataFrame:
    """(n, f1, f2, m, row, p): each class of equal sets with its smallest id and one of its rows."""
    full = rows.filter("n > 0 and doc_id is not null")
    return common.written(full.groupBy("n", "f1", "f2").agg(F.min(F.struct(F.col("doc_id").alias("m"), "row", "p")).alias("x")).select("n", "f1", "f2", "x.*"), "classes")


def _sets(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, classes, and the sets that may be linked to another class."""
    slices, n_bytes = S.sliced(docs.select("doc_id", "text"))
    rows = common.written(_signatures(slices, k), "signatures")
    classes = _classes(rows)
    chosen = classes.groupBy("p").agg(F.collect_list("row").alias("rows"))  # no more than a slice has rows
    shards = n_bytes // SHINGLE_BYTES // SHARD + 1
    answers = _frequencies(slices, chosen, k, shards)
    sets = common.written(_survivors(slices, chosen, answers, k, percent, shards), "sets")
    return rows, classes, sets


def similar_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The whole join: (doc_id, class) for every row, and (a, b), a < b, for every two linked classes.

    A class is told by one of its rows, a number; rows without an id or words have none. Groups of thousands of near copies have
    millions of links; ask for components() where that is all you need.
    """
    rows, classes, sets = _sets(docs, k, percent)
    pairs = _candidates(sets)
    links = _open_links(sets, pairs.filter(F.col("orders").bitwiseAND(1) == 1), None, percent)
    key = ["n", "f1", "f2"]
    member = rows.join(classes.select(*key, F.col("row").alias("class")), key, "left")
    member = member.select("doc_id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
    return member, links.distinct()


def linked(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n, component) for every row of docs(doc_id, text): n is the size of its set, component the smallest id reachable by
    links, 100 * intersection >= percent * union, its own if it has none.

    A row without words has n 0 and is linked with nothing, as is one with a null id, whose component is null. Rows that share an
    id and a text share a component; rows that share an id but not the text are documents of their own. Very long texts are
    hashed a slice at a time. An empty table gives an empty table; other columns play no part.
    """
    rows, classes, sets = _sets(docs, k, percent)
    pairs = _candidates(sets)
    links = _verified(sets, pairs.filter(F.col("orders") == (1 << ORDERS) - 1).select("a", "b"), percent)
    comp = components.components(links)
    more = _open_links(sets, pairs.filter(F.col("orders").bitwiseAND(1) == 1), comp, percent)
    comp = components.components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    common.dropped(sets, pairs, links, more)
    least = classes.join(comp.withColumnRenamed("node", "row"), "row").groupBy("component").agg(F.min("m").alias("least"))
    named = comp.join(least, "component").select(F.col("node").alias("row"), "least")
    key = ["n", "f1", "f2"]
    of_class = classes.join(named, "row", "left").select(*key, F.coalesce("least", "m").alias("component"))
    full = rows.filter("n > 0 and doc_id is not null").join(of_class, key).select("doc_id", "n", "component")
    return full.union(rows.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component")))


def ngram_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: four-word shingles, a similarity of 0.85; odd rows are as in linked()."""
    return linked(docs, 4, 85).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
