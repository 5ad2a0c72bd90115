"""Clusters against exact integers, and intervals that hold what they must."""

import hashlib

import numpy as np
import pytest

from sparkloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, v string, total string"


def brute(rows, k=40, rounds=5, dim=64):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [list(v) for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in set(at):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted([(i, j, d, sum(e for _, b, e in found if b == j), sum(e for *_, e in found), sha[j]) for i, j, d in found], key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(rng.normal(size=64) * 0.2).tolist()) for i in range(150)]
    rows += [(i, rows[i % 7][1]) for i in range(150, 190)]  # equal vectors
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[9][1]), (None, None), (900, None), (901, []), (902, [0.5] * 63), (903, [None, *[0.1] * 63])]
    rows += [(904, [float("nan"), *[0.1] * 63]), (905, [float("inf"), *[0.1] * 63]), (906, [0.0] * 64), (907, [-1.0] * 64), (908, [3000.0] * 64)]
    df = spark.createDataFrame([(i, v, "c", "v", None) for i, v in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, centroids.cluster(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(i, [i / 8] * 64) for i in range(n)]
    df = spark.createDataFrame([(i, v, "c", "v", None) for i, v in rows], SCHEMA)
    out = centroids.cluster(df)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("size", [3, 300, 1 << 15, (1 << 27) - 1])
def test_intervals_hold_the_exact_value(size):
    rng = np.random.default_rng(size)
    x, c = rng.integers(-size, size + 1, (200, 64)), rng.integers(-size, size + 1, (40, 64))
    x[:20] = c[:20] + rng.integers(-1, 2, (20, 64))
    x, c = np.clip(x, -size, size), np.clip(c, -size, size)
    low, high = centroids.intervals(x, c)
    exact = (c * c).sum(1)[None].astype(object) - 2 * (x.astype(object) @ c.T.astype(object))
    assert all(int(np.floor(a)) <= e <= int(np.ceil(b)) for a, e, b in zip(low.ravel().tolist(), exact.ravel().tolist(), high.ravel().tolist()))


@pytest.mark.parametrize("size", [2, 2000, 1 << 26])
def test_ties_and_near_ties(size):
    rng = np.random.default_rng(1)
    c = rng.integers(-size, size + 1, (40, 64))
    c[7], c[21], c[30] = c[3], c[3], c[11]
    c[22] = c[4] + (np.arange(64) == 5)  # next to another one
    x = np.concatenate([c, (c[rng.integers(0, 40, 500)] + c[rng.integers(0, 40, 500)]) // 2, c[4][None], c[22][None]])
    number, distance, exact = centroids.nearest(x, c)
    d = [[sum((int(p) - int(q)) ** 2 for p, q in zip(v, m)) for m in c] for v in x]
    assert distance.tolist() == [min(r) for r in d] and number.tolist() == [r.index(min(r)) for r in d]
    assert len(x) <= exact < 40 * len(x)


def test_too_large_is_told(spark):
    df = spark.createDataFrame([(1, [1e9] * 64, "c", "v", None)], SCHEMA)
    with pytest.raises(Exception, match="or more"):
        centroids.cluster(df).collect()
