"""The n-gram join against all pairs, and what the prefixes promise."""

import numpy as np
import pytest

from sparkloom.llm import minhash, ngram_join
from sparkloom.llm import words as W

SCHEMA = "doc_id long, text string, row string, p string, n string, class string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, k):
    w = [x.decode() for x in (text or "").translate(LOWER).encode().split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def pairs_of(docs, k, percent):
    sets = [grams(t, k) for _, t in docs]
    near = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    return sets, [(i, j) for i in range(len(docs)) for j in range(i) if docs[i][0] is not None and docs[j][0] is not None and near(sets[i], sets[j])]


def brute(docs, k, percent):
    sets, pairs = pairs_of(docs, k, percent)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def corpus(seed, bases=6, copies=25):
    """Groups of copies edited a little or a lot, some only linked through others, shared passages, and odd rows."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passage = word(40)
    texts = []
    for b in range(bases):
        base = word(int(rng.integers(30, 160)))
        for c in range(copies):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                i = int(rng.integers(0, len(w)))
                w[i : i + int(rng.integers(0, 2))] = word(int(rng.integers(0, 2)))
            if c % 5 == 4:
                base = w  # a chain of copies of copies
            texts.append(" ".join(w))
        texts += [" ".join(base), " ".join(base).upper(), "  ".join(base) + "\n"]
    for _ in range(30):
        texts.append(" ".join(word(8) + passage[: int(rng.integers(20, 40))] + word(int(rng.integers(0, 8)))))
    texts += ["a", "A", "a b", "a b c", "a b c d", "A B C D", "x y z", "", " \n", "É é À", "é É À", " ".join(passage)]
    ids = rng.permutation(len(texts)).tolist()
    docs = list(zip(ids, texts))
    return docs + [(docs[3][0], docs[3][1]), (docs[3][0], docs[70][1]), (None, docs[3][1]), (None, None), (9000, None), (9001, " ".join(word(30_000)))]


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, t, "r", "p", "n", "c") for i, t in docs], SCHEMA).repartition(parts)


@pytest.mark.parametrize("k,percent,seed", [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_against_all_pairs(spark, k, percent, seed):
    docs = corpus(seed)
    expected = brute(docs, k, percent)
    assert len({c for _, _, c in expected}) < len(docs) - 60
    assert sorted(map(tuple, ngram_join.linked(frame(spark, docs), k, percent).collect()), key=str) == expected


def test_digest(spark):
    docs = corpus(7, 2, 12)
    out = ngram_join.ngram_digest(frame(spark, docs))
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, 4, 85)


def test_whole_join(spark):
    docs = [(i, t) for i, (_, t) in enumerate(corpus(5, 3, 15)[:-6])]
    sets, pairs = pairs_of(docs, 4, 85)
    member, links = ngram_join.similar_classes(frame(spark, docs), 4, 85)
    of = {r["doc_id"]: r["class"] for r in member.collect()}
    got = {tuple(r) for r in links.collect()}
    assert got == {tuple(sorted((of[i], of[j]))) for i, j in pairs if sets[i] != sets[j]} and len(got) > 30
    assert all(of[i] == of[j] for i, j in pairs if sets[i] == sets[j])


def test_members_that_only_meet_the_pivot(spark):
    """Two of a bucket are linked with each other, but not with its pivot."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(100)]
    docs = [(0, " ".join(base))]
    for g in range(6):
        cut = base[:85] + [f"g{g}x{i}" for i in range(20)]
        for c in range(4):
            w = list(cut)
            w[int(rng.integers(0, 80))] = f"c{g}{c}"
            docs.append((len(docs), " ".join(w)))
    assert sorted(map(tuple, ngram_join.linked(frame(spark, docs), 2, 85).collect()), key=str) == brute(docs, 2, 85)


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_prefixes_of_linked_sets_meet_under_every_order(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        a = rng.choice(400, int(rng.integers(1, 120)), replace=False)
        b = np.unique(np.append(a[rng.random(len(a)) > 0.08], rng.integers(0, 400, int(rng.integers(0, 8)))))
        a, b = (W.mix(np.unique(x).astype(np.uint64)) for x in (a, b))
        inter = len(np.intersect1d(a, b))
        if not len(b) or 100 * inter < percent * (len(a) + len(b) - inter):
            continue
        kind = lambda s: (s % W.U64(5) + W.U64(1)).astype(np.uint8)
        for p, q in zip(ngram_join.prefixes(a, kind(a), percent), ngram_join.prefixes(b, kind(b), percent), strict=True):
            assert len(np.intersect1d(p, q))


def test_slices_without_a_class_of_their_own(spark):
    """Copies only, in every slice but one, and a slice without words."""
    docs = [(i, "one two three four five six") for i in range(40)] + [(100 + i, None) for i in range(5)]
    assert sorted(map(tuple, ngram_join.linked(frame(spark, docs, 8), 4, 85).collect()), key=str) == brute(docs, 4, 85)


def test_nothing(spark):
    assert ngram_join.ngram_digest(frame(spark, [(1, "a")]).limit(0)).collect() == []
    assert [tuple(r) for r in ngram_join.ngram_digest(frame(spark, [(1, "one two three four five")], 1)).collect()] == [(1, 2, 1)]


def test_frequency_classes():
    assert ngram_join.classes_of(np.array([1, 2, 3, 4, 15, 16, 64, 10**12])).tolist() == [0, 1, 1, 2, 2, 3, 4, 20]
    s = np.concatenate(minhash.shingle_sets(__import__("pyarrow").array(["a b c d e f"]), 2))
    assert (ngram_join.counters(s, 7) >> W.U64(32)).max() < 7
