"""Neighbours of all vectors at once against every pair."""

import numpy as np
import pytest

from sparkloom.operators import batch_vectors, vectors


def near(x, ids, k, bits):
    out = set()
    for i in range(len(x)):
        cost = [(int(np.bitwise_count((x[i] ^ y).view(np.uint64)).sum()) if bits else -int(x[i] @ y), int(j)) for y, j in zip(x, ids)]
        best = sorted(c for c in cost if c[1] != ids[i])[:k]
        out |= {(int(ids[i]), j, c if bits else -c, r) for r, (c, j) in enumerate(best, 1)}
    return out


def table(spark, x, ids, column):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], f"vec_id long, {column} array<long>").repartition(3)


def clustered(rng, n, words):
    """Groups of codes a few bits apart, equal ones and lonely ones."""
    centres = rng.integers(-(2**63), 2**63, (6, words))
    x = centres[rng.integers(0, 6, n)]
    for _ in range(3):
        flip = rng.random(n) < 0.6
        x[flip, rng.integers(0, words)] ^= np.int64(1) << rng.integers(0, 63, flip.sum())
    x[: n // 20] = rng.integers(-(2**63), 2**63, (n // 20, words))
    return x


@pytest.mark.parametrize("words", [1, 2])
@pytest.mark.parametrize("full", [4096, 5])
def test_shortlists(spark, words, full, monkeypatch):
    monkeypatch.setattr(batch_vectors, "FULL", full)
    monkeypatch.setattr(vectors, "pool", lambda k: k)
    rng = np.random.default_rng(words)
    x, ids = clustered(rng, 400, words), rng.permutation(400)
    got = batch_vectors.shortlists(table(spark, x, ids, "bits"), 12)
    assert {tuple(r) for r in got.select("query", "id", "score", "rank").collect()} == near(x, ids, 12, True)


def test_chunks_within_the_bound(spark):
    """All pairs nearer than the bound come out, each once."""
    rng = np.random.default_rng(9)
    x = np.unique(clustered(rng, 300, 1), axis=0)
    codes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "code long, bits array<long>")
    for t in (0, 1, 2):
        found, full = batch_vectors._near_codes(codes, codes, 1, t)
        got = [tuple(r) for r in found.collect()]
        d = {(i, j): int(np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).sum()) for i in range(len(x)) for j in range(len(x))}
        assert full.count() == 0 and len(got) == len(set(got)) and set(got) == {(i, j, n) for (i, j), n in d.items() if n < 4 * (t + 1)}


def test_dot_products_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(batch_vectors, "BLOCK", 64)
    rng = np.random.default_rng(3)
    x, ids = rng.integers(-3, 4, (200, 8)), rng.permutation(200)  # many ties
    rows = table(spark, x, ids, "code")
    got = batch_vectors.neighbours(rows, rows, 7, "code")
    assert {tuple(r) for r in got.select("query", "id", "score", "rank").collect()} == near(x, ids, 7, False)
    assert batch_vectors.neighbours(rows.limit(0), rows.limit(0), 7, "code").count() == 0 == batch_vectors.shortlists(rows.limit(0).withColumnRenamed("code", "bits"), 2).count()


@pytest.mark.parametrize("part", [16, 4096])
@pytest.mark.parametrize("most", [3, 5000, 2**27])
def test_parts_of_a_block(part, most, monkeypatch):
    """Floats of both widths and integers, many ties, with and without a floor, met in many parts: as all pairs."""
    monkeypatch.setattr(batch_vectors, "PART", part)
    rng = np.random.default_rng(most % 97)
    x, ids = rng.integers(-most, most + 1, (300, 8)), rng.permutation(300)
    own = rng.permutation(300)[:90]
    for floor in (None, int(2 * most**2)):
        got = batch_vectors._nearest(ids, x, ids[own], x[own], 7, False, None if floor is None else -floor)
        expected = {(q, j, s) for q, j, s, _ in near(x, ids, 7, False) if q in set(ids[own].tolist()) and (floor is None or s >= floor)}
        assert {(int(q), int(i), -int(c)) for q, i, c in zip(*got)} == expected and len(got[0]) == len(expected)


def test_cells_do_not_multiply(spark):
    """All vectors that fit a block are one: a cell gives k rows a query, so that what is shuffled would grow with the number of cells."""
    rng = np.random.default_rng(5)
    rows = table(spark, rng.integers(-(2**63), 2**63, (9000, 1)), np.arange(9000), "bits")
    real = spark.sparkContext.accumulator(0)

    def counting(*args):
        found = counted(*args)
        real.add(len(found[0]))
        return found

    counted, batch_vectors._nearest = batch_vectors._nearest, counting
    try:
        out = batch_vectors.neighbours(rows, rows.filter("vec_id < 50"), 7, "bits").count()
    finally:
        batch_vectors._nearest = counted
    assert out == 50 * 7 == real.value
