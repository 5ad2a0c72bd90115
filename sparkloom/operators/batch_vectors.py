"""Neighbours of many vectors at once, exactly: multi-index hashing over sign bits, and blocks for what it leaves.

Two codes of w words that differ in fewer than 4 w (t + 1) bits differ in t bits or fewer in one of their 4 w chunks of 16 bits. So codes
are put in buckets by chunk, and a query looks in all buckets within t bits of its own ones; whatever is nearer than that bound
is found there. Equal codes are one. A query is settled by the first t at which the bound holds as many vectors as it asks
for. Queries with a bucket so full that looking through it would be no better, and those no round settles, meet all vectors in
blocks, as do dot products, for which bits give no bound.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared
from . import vectors

CHUNK = 16
#: Bits by which chunks may differ, round by round.
ROUNDS = (0, 1)
#: Codes of a bucket beyond which a query goes to the blocks.
FULL = 4096
#: Queries of a block, bytes of the vectors of a block, and vectors that a block of queries meets at a time.
BLOCK = 16384
BLOCK_BYTES = 32 << 20
PART = 4096


def _masks(t: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(t + 1) for bits in itertools.combinations(range(CHUNK), n)]


def _chunk(bits: Column, j: int) -> Column:
    """Chunk j of a code, an array of words."""
    word, part = divmod(j, 64 // CHUNK)
    return F.shiftrightunsigned(bits[word], part * CHUNK).bitwiseAND((1 << CHUNK) - 1).cast("int")


def _distance(a: Column, b: Column, words: int) -> Column:
    out = F.lit(0)
    for w in range(words):
        out = out + F.bit_count(a[w].bitwiseXOR(b[w]))
    return out


def _near_codes(codes: DataFrame, asked: DataFrame, words: int, t: int) -> tuple[DataFrame, DataFrame]:
    """(code, other, hamming) for all codes nearer to the asked ones than the bound of t, and the asked ones whose buckets are too full.

    codes and asked are (code, bits). A pair is taken once, at its first chunk within t.
    """
    n = words * 64 // CHUNK
    chunks = lambda df, name: df.select(F.col("code").alias(name), F.col("bits").alias(f"{name}_bits"), F.posexplode(F.array(*[_chunk(F.col("bits"), j) for j in range(n)])).alias("j", "value"))
    buckets = chunks(codes, "other")
    sizes = buckets.groupBy("j", "value").agg(F.count(F.lit(1)).alias("n"))
    looks = chunks(asked, "code").withColumn("value", F.explode(F.transform(F.array(*map(F.lit, _masks(t))), lambda m: F.col("value").bitwiseXOR(m))))
    full = looks.join(sizes.filter(F.col("n") > FULL), ["j", "value"], "left_semi").select("code").distinct()
    pairs = looks.join(full, "code", "left_anti").join(buckets, ["j", "value"])
    first = F.coalesce(*[F.when(F.bit_count(_chunk(F.col("code_bits"), j).bitwiseXOR(_chunk(F.col("other_bits"), j))) <= t, F.lit(j)) for j in range(n)])
    found = pairs.filter(F.col("j") == first).select("code", "other", _distance(F.col("code_bits"), F.col("other_bits"), words).alias("hamming"))
    return found.filter(F.col("hamming") < n * (t + 1)), full


def _costs(v: np.ndarray, bits: bool, largest: int) -> Callable[[np.ndarray], np.ndarray]:
    """What gives some queries, of components up to largest, their costs to v, the least for the best: different bits, or the negative dot
    product. Products go through floats where these hold every sum exactly, as numpy multiplies only those in blocks; else through integers."""
    if bits:
        one = lambda q, w: np.bitwise_count((q[:, w, None] ^ v[None, :, w]).view(np.uint64))
        return lambda q: one(q, 0) if v.shape[1] == 1 else sum(one(q, w).astype(np.int32) for w in range(v.shape[1]))
    widest = v.shape[1] * int(np.abs(v).max(initial=1)) * largest
    kind = np.float32 if widest < 2**24 else np.float64 if widest < 2**53 else np.int64
    across = np.ascontiguousarray(-v.astype(kind).T)
    return lambda q: q.astype(kind) @ across


def _nearest(ids: np.ndarray, v: np.ndarray, own: np.ndarray, q: np.ndarray, k: int, bits: bool, most: int | None) -> list[np.ndarray]:
    """[query, id, cost]: for each of the queries (own, q) its k least costs among the vectors (ids, v), itself excepted, none above `most`.

    Vectors are met part by part. A cost above what was a query's k-th least is not looked at again, and what is found is merged
    when it has become as much as is kept.
    """
    edge = np.full(len(own), np.iinfo(np.int64).max if most is None else most, np.int64)
    found, pending = [], 0  # (place of the query, id, cost) of what is kept and what has come since
    largest = 0 if bits else int(np.abs(q).max(initial=1))
    for at in range(0, len(ids), PART):
        cost, there = _costs(v[at : at + PART], bits, largest), ids[at : at + PART]
        for first in range(0, len(own), 256):
            c, e = cost(q[first : first + 256]), edge[first : first + 256]
            limit = e.astype(c.dtype) if c.dtype.kind == "f" else np.clip(e, np.iinfo(c.dtype).min, np.iinfo(c.dtype).max).astype(c.dtype)
            if most is None and at == 0 and c.shape[1] > k:  # no edge yet: that of this part, the query itself among it
                limit = np.minimum(limit, np.partition(c, k, axis=1)[:, k])
            i, j = np.divmod(np.flatnonzero(c <= limit[:, None]), c.shape[1])
            some = there[j] != own[i + first]
            i, j = i[some], j[some]
            found.append((i + first, there[j], c[i, j].astype(np.int64)))
            pending += len(i)
        if at == 0 or pending > len(own) * k or at + PART >= len(ids):
            i, id_, c = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((id_, c, i))
            i, id_, c = i[order], id_[order], c[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            found, pending = [(i[rank < k], id_[rank < k], c[rank < k])], 0
            edge[i[rank == k - 1]] = c[rank == k - 1]
    return [own[found[0][0]], *found[0][1:]]


def neighbours(rows: DataFrame, asked: DataFrame, k: int, column: str, id_: str = "vec_id", floor: float | None = None) -> DataFrame:
    """(query, id, score, rank): for each of asked the k other rows with the highest integer dot product of their codes (column
    "code") or the fewest different bits ("bits"); ties to the smaller id. With a floor, dot products under it are left out.

    Rows and queries are dealt to cells of blocks by hash; a cell gives k rows a query, which a window merges. A block of rows is as large as
    BLOCK_BYTES allow, as what cells give grows with the number of blocks of rows, and what they are given with those of queries.
    """
    bits = column == "bits"
    most = None if floor is None or bits else -math.ceil(floor)
    n, n_asked = rows.count(), asked.count()
    first = rows.select(F.size(column)).first()
    wide = max(1, first[0] if first else 1) * (8 if bits else 4) + 8
    a = max(1, -(-n * wide // BLOCK_BYTES))
    b = max(1, -(-n_asked // BLOCK), min(n_asked // 1024, 2 * rows.sparkSession.sparkContext.defaultParallelism))
    salt = F.xxhash64(id_)
    left = rows.select(F.col(id_).alias("id"), F.col(column).alias("v"), F.pmod(salt, F.lit(a)).cast("long").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("b"))
    right = asked.select(F.col(id_).alias("id"), F.col(column).alias("v"), F.pmod(salt, F.lit(b)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a - 1).cast("long"))).alias("a"))
    schema = T.StructType([T.StructField("query", rows.schema[id_].dataType), T.StructField("id", rows.schema[id_].dataType), T.StructField("score", T.LongType())])

    def matrix(t: pa.Table) -> np.ndarray:
        return vectors._matrix(t.column("v").combine_chunks(), np.int64)

    def cell(x: pa.Table, q: pa.Table) -> pa.Table:
        cols = [np.zeros(0, np.int64)] * 3
        if x.num_rows and q.num_rows:
            cols = _nearest(x.column("id").to_numpy().astype(np.int64), matrix(x), q.column("id").to_numpy().astype(np.int64), matrix(q), k, bits, most)
        query, near, cost = cols
        return pa.table([pa.array(c, pa.int64()) for c in (query, near, cost if bits else -cost)], names=schema.names)

    cells = [shared.dealt(x, "a", "b") for x in (left, right)]
    near = cells[0].groupBy("a", "b").cogroup(cells[1].groupBy("a", "b")).applyInArrow(cell, schema)
    best = Window.partitionBy("query").orderBy(F.asc("score") if bits else F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def shortlists(rows: DataFrame, k: int, id_: str = "vec_id") -> DataFrame:
    """(query, id, score, rank): for every row the pool(k) others nearest to it by sign bits, ties to the smaller id.

    rows are vectors.index(); ids are whole numbers and tell rows apart.
    """
    most = vectors.pool(k)
    first = rows.select(F.size("bits")).first()
    if first is None:
        return neighbours(rows, rows, most, "bits", id_)
    words = first[0]
    members = shared.written(rows.select(F.col(id_).alias("id"), F.xxhash64("bits").alias("code"), "bits"), "members")
    codes = shared.written(members.groupBy("bits").agg(F.min("id").alias("code"), F.count(F.lit(1)).alias("n")), "codes")
    members = members.drop("code").join(codes, "bits").select("id", "code")
    asked, settled = codes, None
    for t in ROUNDS:
        near, full = _near_codes(codes.select("code", "bits"), asked.select("code", "bits"), words, t)
        near = shared.written(near, "near")
        enough = near.join(codes.select(F.col("code").alias("other"), "n"), "other").groupBy("code").agg(F.sum("n").alias("held")).filter(F.col("held") > most).select("code")
        # Codes nearest first until they hold what is asked for: only their members come out.
        ranked = near.join(enough, "code", "left_semi").join(codes.select(F.col("code").alias("other"), "n"), "other")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("code").orderBy("hamming").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = ranked.withColumn("before", before).filter(F.col("before") <= most).select("code", "other", "hamming")
        out = members.withColumnRenamed("id", "query").join(kept, "code").join(members.select("id", F.col("code").alias("other")), "other").filter("query <> id").select("query", "id", F.col("hamming").cast("long").alias("score"))
        best = Window.partitionBy("query").orderBy("score", "id")
        out = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
        settled = out if settled is None else settled.unionByName(out)
        asked = shared.written(asked.join(enough, "code", "left_anti"), "asked")
        if asked.isEmpty():
            return settled
    left = rows.join(members.join(asked.select("code"), "code", "left_semi").select(F.col("id").alias(id_)), id_, "left_semi")
    return settled.unionByName(neighbours(rows, left, most, "bits", id_))


def kin(rows: DataFrame, language: str, name: str, k: int = 16, shown: int = 5, id_: str = "vec_id") -> DataFrame:
    """(query, id, score, rank): vectors.kin() of every row: of its k nearest those with a score of KIN_FLOOR, an uncommon name
    and another language; the first `shown`."""
    first = rows.select("scale").first()  # one number, the same in all rows
    # Less than the floor by more than rounding: only lower scores are left out before the floor itself is applied.
    near = neighbours(rows, rows, k, "code", id_, vectors.KIN_FLOOR * first[0] ** 2 - 1 if first else None).drop("rank")
    told = rows.select(F.col(id_).alias("id"), F.col(language).alias("_theirs"), F.col(name).alias("_name"), "scale")
    own = rows.select(F.col(id_).alias("query"), F.col(language).alias("_own"))
    near = near.join(told, "id").join(own, "query").filter((F.col("score") / (F.col("scale") * F.col("scale")) >= vectors.KIN_FLOOR) & (F.col("_theirs") != F.col("_own")))
    near = near.join(vectors.common_names(rows, name).select(F.col(name).alias("_name")), "_name", "left_anti")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= shown).select("query", "id", "score", "rank")
