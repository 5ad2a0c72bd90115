"""The sharded sketch: any number of shards gives the same words, and counts are never too low."""

import collections
import hashlib

import numpy as np
import pytest

from sparkloom.llm import countmin, substring_dedup


def corpus():
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    shared = [fresh(int(n)) for n in (60, 75, 52, 120)]
    docs = []
    for i in range(160):
        w = fresh(int(rng.integers(0, 400)))
        for k in range(4):
            if i % (k + 3) == 0:
                a, cut = int(rng.integers(0, len(w) + 1)), int(rng.integers(0, 8))
                w[a:a] = shared[k][cut:]
        docs.append((i, " ".join(w)))
    docs += [(500, docs[4][1]), (500, docs[4][1]), (501, None), (None, docs[6][1]), (502, " ".join(fresh(30_000)))]
    return docs


def brute(docs, width=50):
    first = {}
    for i, t in docs:
        w = (t or "").split()
        for a in range(len(w) - width + 1) if i is not None else ():
            g = tuple(w[a : a + width])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        w = (t or "").split()
        gone = {a + k for a in range(len(w) - width + 1) if i is not None and first[tuple(w[a : a + width])] < i for k in range(width)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for a, x in enumerate(w) if a not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_shard", [1 << 18, 300, 16])
def test_shards_give_the_same(spark, per_shard, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    expected = brute(docs)
    assert sum(r[2] > 0 for r in expected) > 40
    assert sorted(map(tuple, substring_dedup.substring_digest(df, per_shard=per_shard).collect()), key=str) == expected


def test_small_slices(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", 3)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, substring_dedup.substring_digest(df).collect()), key=str) == brute(docs)


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    plan = substring_dedup.substring_digest(df)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange" in line and "text" in line]


def test_counts_are_never_too_low():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    keys = np.concatenate([keys, keys[:700]])
    weight = np.ones(len(keys), int)
    weight[1000:1100] = 2
    true = collections.Counter()
    for k, w in zip(keys.tolist(), weight.tolist(), strict=True):
        true[k] += w
    for width in (64, 4096, 1 << 15):
        got = countmin.twice(keys, weight, width)
        assert all(g for k, g in zip(keys.tolist(), got, strict=True) if true[k] > 1)
    assert got.mean() < 0.35
