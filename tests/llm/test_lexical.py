"""Ranked search against scores by definition."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import lexical

DOCS = "doc_id long, text string, terms string, impacts string, score long"
ITEMS = "item_id long, text string, block string, query string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    docs = [(i, collections.Counter(split(t))) for i, t in docs if i is not None]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if i is not None}:
        scores = []
        for i, c, n in docs:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(split(text)) if t in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus(rng):
    words = [f"w{i}" for i in range(40)] + ["Über", "über", "ÉÀ", "漢字", "a1_b2", "don't", "X-Ray", "x", "RAY"]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(300)]
    docs += [(400 + i, "tie tie more") for i in range(30)] + [(7, docs[7][1]), (7, docs[8][1]), (None, text(20)), (500, None), (501, ""), (502, "-- ''\n\t")]
    docs += [(503, text(60_000)), (504, "q" * 100_000)]
    items = [(i, text(int(rng.integers(1, 12)))) for i in range(25)]
    items += [(50, "tie"), (51, None), (52, ""), (53, "absent"), (None, "w1"), (3, items[3][1]), (3, "w1 w1 W1"), (54, "q" * 100_000), (55, "ray X über ÜBER")]
    return docs, items


@pytest.mark.parametrize("shard,limit", [(1 << 23, 1 << 22), (500, 400)])
def test_against_brute_force(spark, shard, limit):
    docs, items = corpus(np.random.default_rng(4))
    df = spark.createDataFrame([(i, t, "x", None, 3) for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, "b", None) for i, t in items], ITEMS).repartition(2)
    index = lexical.build_index(df, shard)
    out = lexical.search(index, asked, limit=limit)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect())) == brute(docs, items)
    assert index.table.count() > (20 if shard == 500 else 2)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some, asked = spark.createDataFrame([(1, "a b", "", "", 0)], DOCS), spark.createDataFrame([(1, "a", "", "")], ITEMS)
    for d, q in ((docs, items), (docs, asked), (some, items)):
        assert lexical.ranked_digest(d, q).collect() == []
    assert [tuple(r) for r in lexical.ranked_digest(some, asked).collect()] == brute([(1, "a b")], [(1, "a")])


def test_terms():
    texts = ["Ab aB ab", None, "", "a_b-c'd 1x", "ÉéÀ Éé"]
    hashes, at = lexical.terms_of(pa.array(texts, pa.string()))
    assert np.diff(at).tolist() == [len(split(t)) for t in texts]
    words = [w for t in texts for w in split(t)]
    assert len(set(hashes.tolist())) == len(set(words))


def test_best_keeps_ties():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores, ids = rng.integers(0, 4, 50), rng.permutation(50)
        expected = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if s > 0)[:10]
        at = lexical.best(scores, ids, 10)
        assert [(-scores[j], ids[j]) for j in at] == expected


def test_large_counts_do_not_overflow():
    tf, n = np.array([1, 10**6]), np.array([10**7, 10**7])
    got = lexical.impacts(tf, n, 10**12, 5 * 10**15)
    assert got.tolist() == [10**9 * t // (1000 * t + 8 * (10 + 90 * 10**7 * 10**12 // (5 * 10**15))) for t in tf.tolist()]
