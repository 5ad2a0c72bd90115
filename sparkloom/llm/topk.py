"""Exact top-k inner-product search by no-random-access aggregation (NRA) over blocks of sorted lists.

The scores of a query are sums over dimensions, and every block of candidates has one list a dimension, sorted by value.
A query reads lists from the end that its sign wants: all to a common depth, then one after the other to their ends, those
first that can move its score most (the component's size times the list's spread). A component that has been read is known;
one that has not lies between the list's last value and the value read last. So every candidate has bounds,

    upper: unread components at the list's frontier,  lower: unread components at the list's worst value,

which for a block of queries are products with clipped copies of the block. A candidate whose upper bound is below the k-th
best lower bound is an outsider and is read no further. A query stops when few candidates are left that can qualify, and
their final scores are resolved; one that reads all lists to their ends has exact scores, as the bounds meet there.

Queries and candidates meet in cells, each a block of either; both sides are dealt to cells by a hash, so no side is
broadcast and a cell's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The depth to which all lists are read, as a share of their entries.
DEPTH = 1 / 16
#: Shares of the lists read to their ends after which bounds are computed.
ROUNDS = (3 / 4, 7 / 8, 15 / 16, 1)
EXACT = 2**53
#: Components of a block of candidates: a cell holds some copies of one as doubles, so 8 million are some 400 MB.
COMPONENTS = 1 << 23


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component as array<bigint>.

    Vectors that are null, empty or hold null or non-finite components, and null ids, take no part. Rows that repeat an
    id and its vector count once.
    """
    x = F.col("x")
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    rows = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter((F.size(x) > 0) & good)
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(e * scale)).alias("v")).distinct()


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best by score, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _exact(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By definition, with integers of any size: for components so large that doubles would round their products.

    Scores outside the range of long are ordered as they are and reported as its end.
    """
    out, xs = [], x.astype(object)
    for i in range(len(q)):
        score = xs @ q[i].astype(object)
        at = [j for j in sorted(range(len(x)), key=lambda j: (-score[j], ids[j])) if ids[j] != q_ids[i]][:k]
        out.append((np.array(at, np.int64), np.array([min(max(score[j], -(2**63)), 2**63 - 1) for j in at], np.int64)))
    return out


class _Lists:
    """The sorted lists of a block at the common depth: clipped copies for the bounds of components not read on."""

    def __init__(self, x: np.ndarray, k: int) -> None:
        n = len(x)
        lists = np.sort(x, axis=0)
        t = min(n, max(k + 1, int(n * DEPTH)))
        top, bottom = lists[n - t], lists[t - 1]
        self.x, self.share = x, t / n
        self.spread = lists[-1] - lists[0]
        self.best = np.maximum(x, top), np.minimum(x, bottom)
        self.worst = np.where(x >= top, x, lists[0]), np.where(x <= bottom, x, lists[-1])


def block_top_k(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, few: int = 64, read: list[float] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the indexes and scores of its k best among the rows of x but its own.

    read gets, for each query, the share of the lists' entries that it read before it stopped; 1 is all of them.
    """
    n = len(x)
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] >= EXACT:
        return _exact(q, q_ids, x, ids, k)
    lists = _Lists(x.astype(np.float64), k)
    own: dict[int, list[int]] = {}
    for j in np.flatnonzero(np.isin(ids, q_ids)).tolist():
        own.setdefault(int(ids[j]), []).append(j)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    some = max(1, (1 << 20) // max(1, n))
    for a in range(0, len(q), some):
        found += _search(q[a : a + some].astype(np.float64), q_ids[a : a + some], lists, ids, k, few, own, [] if read is None else read)
    return found


def _search(q: np.ndarray, q_ids: np.ndarray, lists: _Lists, ids: np.ndarray, k: int, few: int, own: dict[int, list[int]], read: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    x, dim = lists.x, q.shape[1]
    n = len(x)
    order = np.argsort(-np.abs(q) * lists.spread, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(dim)[None], axis=1)
    whole = place < int(np.ceil(dim * ROUNDS[0]))  # the lists that the first round reads to their ends
    known, up, down = np.where(whole, q, 0), np.where(whole, 0, np.maximum(q, 0)), np.where(whole, 0, np.minimum(q, 0))
    score = known @ x.T
    upper = score + up @ lists.best[0].T + down @ lists.best[1].T
    lower = score + up @ lists.worst[0].T + down @ lists.worst[1].T
    found: list = []
    for i in range(len(q)):
        mine = own.get(int(q_ids[i]), [])
        upper[i, mine] = lower[i, mine] = -np.inf
        floor = np.partition(lower[i], n - k)[n - k] if n > k else -np.inf
        able = np.flatnonzero((upper[i] >= floor) & np.isfinite(upper[i]))  # no other can qualify
        entries, share = n * dim * lists.share + n * (1 - lists.share) * int(np.ceil(dim * ROUNDS[0])), ROUNDS[0]
        for further in ROUNDS[1:]:
            if len(able) <= few:
                break
            # The next lists, to their ends; entries of outsiders are passed over.
            entries += n * (1 - lists.share) * (int(np.ceil(dim * further)) - int(np.ceil(dim * share)))
            share = further
            cut = int(np.ceil(dim * further))
            done, rest = order[i, :cut], order[i, cut:]
            part = x[np.ix_(able, done)] @ q[i, done]
            hi, lo = np.maximum(q[i, rest], 0), np.minimum(q[i, rest], 0)
            at = np.ix_(able, rest)
            most = part + lists.best[0][at] @ hi + lists.best[1][at] @ lo
            least = part + lists.worst[0][at] @ hi + lists.worst[1][at] @ lo
            if len(able) > k:
                floor = max(floor, np.partition(least, len(able) - k)[len(able) - k])
            able = able[most >= floor]
            if share == 1:
                break
        read.append(entries / (n * dim))
        final = x[able] @ q[i]
        best = _best(final, ids[able], k)
        found.append((able[best], final[best].astype(np.int64)))
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 16384, query_block: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of vectors for every row of queries; both are (vec_id, v).

    A query's own rows (those with its id) are no candidates; ties go to the smaller id; only vectors of the query's
    length are candidates. An empty table on either side gives an empty result.
    """
    spark = vectors.sparkSession
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_q = queries.count()
    # Blocks are no larger than block and COMPONENTS allow, and small enough to keep every core busy.
    block, query_block = (max(1, min(b, COMPONENTS // max(1, dim or 1))) for b in (block, query_block))
    blocks = max(1, -(-n // block), min(-(-n // 1024), 4 * spark.sparkContext.defaultParallelism))
    q_blocks = max(1, -(-n_q // query_block))
    salt = F.xxhash64("vec_id", "v")
    left = vectors.select("*", F.size("v").alias("dim"), F.pmod(salt, F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("c"))
    right = queries.select("*", salt.alias("row"), F.size("v").alias("dim"), F.pmod(salt, F.lit(q_blocks)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "row", "vec_id", "score")])

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("v").combine_chunks().flatten()
        return flat.to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def cell(x: pa.Table, q: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], []]
        if x.num_rows and q.num_rows:
            ids, q_ids, rows = x.column("vec_id").to_numpy(), q.column("vec_id").to_numpy(), q.column("row").to_numpy()
            for i, (at, score) in enumerate(block_top_k(matrix(q), q_ids, matrix(x), ids, k)):
                for c, v in zip(cols, ([q_ids[i]] * len(at), [rows[i]] * len(at), ids[at], score), strict=True):
                    c.append(np.asarray(v, np.int64))
        return pa.table([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols], names=schema.names)

    key = ["b", "c", "dim"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(cell, schema)
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def topk_digest(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The contract's columns: queries are the rows whose vec_id is divisible by `every`.

    Vectors that are null, empty or hold null or non-finite components, and null ids, take no part; rows that repeat an id and
    its vector count once, and an id with several vectors has a list for each as a query. An empty table gives an empty table;
    other columns play no part.
    """
    from . import common

    rows = common.written(scaled(embeddings), "scaled")
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)
