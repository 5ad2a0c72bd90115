"""Centroid clustering of integer vectors: float32 screening with error intervals, exact integers where they overlap.

The nearest of k centroids is decided by |c|^2 - 2 x.c. A float32 matrix product gives x.c for a block of vectors and all
centroids at once; whatever the order of its sums, its error is at most gamma |x| |c| with gamma = (n + 2) u / (1 - (n + 2) u) and
u = 2^-24 (n products and sums, and both factors rounded to float32). So every distance lies in an interval that is sure to hold
it. Centroids whose interval ends below all others are the nearest; where intervals overlap, and for the distance itself,
the shortlisted ones are computed again in 64-bit integers, and equal ones go to the lowest number.

Each round is one pass over the vectors with the centroids as a broadcast (k x dim integers, whatever the data); tasks send a
count and integer sums for each centroid, which Spark adds, and k rows reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Components stay below this size, so that squared distances of 64 components fit 64 bits.
LIMIT = 1 << 27
#: Relative error of one float32 operation.
UNIT = 2.0**-24
#: Vectors of a block.
BLOCK = 4096


def kept(vectors: DataFrame, dim: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, for vectors of dim components of which none is null or non-finite.

    Other vectors, null ones too, take no part. A component of LIMIT or more in size is an error, as its square has no room.
    """
    x = F.col("embedding").cast("array<double>")
    whole = lambda e: F.when(F.abs(e * scale) < LIMIT, F.floor(e * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component is {LIMIT} or more")).cast("int"))
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.filter(F.when(F.size("embedding") == dim, good).otherwise(F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of intervals that hold |c|^2 - 2 x.c for all rows of x and c, which are int64."""
    n = x.shape[1] + 2
    gamma = n * UNIT / (1 - n * UNIT)
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    xx, cc = (x * x).sum(1).astype(np.float64), (c * c).sum(1).astype(np.float64)
    middle = cc - 2 * product
    # The second part is more than what the few double operations here can lose.
    radius = 2 * gamma * np.sqrt(xx)[:, None] * np.sqrt(cc) * (1 + 2.0**-40) + 2.0**-49 * (cc + 2 * np.abs(product))
    return middle - radius, middle + radius


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the number of the nearest row of c and the squared distance; and how many distances were computed exactly."""
    cluster, distance, exact = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    for a in range(0, len(x), BLOCK):
        part = x[a : a + BLOCK]
        low, high = intervals(part, c)
        rows, able = np.nonzero(low <= high.min(1)[:, None])  # by row, then by number
        d = np.square(part[rows] - c[able]).sum(1)
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        least = np.minimum.reduceat(d, first)
        best = np.flatnonzero(d == least[rows])
        _, lowest = np.unique(rows[best], return_index=True)
        cluster[a : a + BLOCK], distance[a : a + BLOCK] = able[best[lowest]], least
        exact += len(d)
    return cluster, distance, exact


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (count, componentwise sum) of the vectors nearest to each centroid that has any."""
    k, dim = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            x = _matrix(batch, dim)
            cluster, _, _ = nearest(x, shared.value)
            order = np.argsort(cluster, kind="stable")
            ids, first, n = np.unique(cluster[order], return_index=True, return_counts=True)
            if len(ids):
                total[ids] += np.add.reduceat(x[order], first, axis=0)
                count[ids] += n
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.field("element", pa.int64(), False)))], schema.names)

    parts = rows.select("v").mapInArrow(run, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    added = lambda key: [F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total")]
    out = {r["cluster"]: (r["n"], list(r["total"])) for r in parts.groupBy("cluster", "salt").agg(*added("salt")).groupBy("cluster").agg(*added("")).collect()}  # k rows
    shared.destroy()
    return out


def start(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order; equal ids go by their vectors. Null ids never start."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.filter("vec_id is not null").orderBy(key, "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in first], np.int64)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """The contract's columns for every kept vector.

    Vectors that are null, of another length or hold null or non-finite components are left out. Rows that repeat an id or a
    vector count as often as they come; a null id is clustered, but starts no centroid. With fewer vectors than k there are
    fewer centroids; an empty table gives an empty table. Only vec_id and embedding are read.
    """
    rows = common.written(kept(vectors, dim, scale), "vectors")
    centroids = start(rows, k, seed)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(centroids):
        none = T.StructType([*schema, T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
        return rows.sparkSession.createDataFrame([], none)
    for _ in range(rounds):
        for i, (n, total) in sums(rows, centroids).items():
            centroids[i] = [t // n for t in total]  # Python's // is the floor
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        number, distance, _ = nearest(_matrix(batch, dim), shared.value)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)], schema.names)

    found = common.written(common.arrow_map(rows, assign, schema), "assigned")
    common.dropped(rows)
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    every = sum(inertia.values())
    told = [(i, s, every, hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, s in inertia.items()]
    of = rows.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
