"""Operators on documents against brute force, with odd rows, and on empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import bpe, components, minhash, packing, quality, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def words(t):
    return WORD.findall(t or "")


def key(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_quality_statistics(odd_docs, no_docs, some_labels):
    got = key(r[:7] for r in quality.quality_digest(odd_docs, some_labels).collect())
    expected = []
    for r in odd_docs.collect():
        w = words(r.text)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        expected.append((r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    assert got == key(expected)
    assert quality.quality_digest(no_docs, some_labels).count() == 0
    assert quality.quality_digest(odd_docs, some_labels.limit(0)).count() == odd_docs.count()


def test_decision_list_learns_a_threshold():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.5)
    rules = quality.learn(x, bad)
    fresh = {"a": rng.random(500), "b": rng.random(500)}
    truth = (fresh["a"] > 0.7) & (fresh["b"] < 0.5)
    assert (rules.predict(fresh) == truth).mean() > 0.97


def test_substring_dedup(odd_docs, no_docs):
    docs = odd_docs.collect()
    first = {}
    for r in docs:
        w = words(r.text)
        for i in range(len(w) - 49) if r.doc_id is not None else ():
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, r.doc_id), r.doc_id)
    expected = []
    for r in docs:
        w = words(r.text)
        gone = set()
        for i in range(len(w) - 49) if r.doc_id is not None else ():
            if first[tuple(w[i : i + 50])] < r.doc_id:
                gone |= set(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert key(substring_dedup.substring_digest(odd_docs).collect()) == key(expected)
    assert substring_dedup.substring_digest(no_docs).count() == 0
    out = substring_dedup.deduplicate_passages(odd_docs)
    assert out.columns == odd_docs.columns
    by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert by[2].text == "" and by[2].n_chars == 0 and by[10].text == "x y" and by[2].spans == "s"


def brute_components(docs, k):
    sets, links = {}, collections.defaultdict(set)
    rows = []
    for r in docs:
        w = words((r.text or "").translate(LOWER))
        s = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        rows.append((r.doc_id, s))
        if r.doc_id is not None and s:
            sets[r.doc_id] = s
    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                links[a].add(b)
    least = {a: a for a in sets}
    for _ in sets:
        least = {a: min(least[b] for b in links[a]) for a in sets}
    return [(i, len(s), least.get(i, i), i is None or least.get(i, i) == i) for i, s in rows]


def test_minhash(spark, odd_docs, no_docs):
    assert key(minhash.minhash_digest(odd_docs, 2).collect()) == key(brute_components(odd_docs.collect(), 2))
    assert minhash.minhash_digest(no_docs).count() == 0
    kept = minhash.keep_one(odd_docs, 5)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {None, 1, 4, 5, 6, 7, 8, 9, 11} | {r.doc_id for r in kept.filter("doc_id in (10, 13)").collect()}


def test_keep_one_judges_rows_of_one_id_by_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, a + " end"), (4, None), (None, a)]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    assert key(kept.collect()) == key([(1, a), (2, b), (2, b), (4, None), (None, a)])


def test_minhash_chain_through_edited_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(200)]
    docs = []
    for i in range(60):
        w = list(base)
        for j in rng.choice(200, rng.integers(0, 22), replace=False):
            w[j] = f"e{i}_{j}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(f"z{rng.integers(0, 4000)}" for _ in range(150))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert key(minhash.minhash_digest(df, 2).collect()) == key(brute_components(df.collect(), 2))


def test_signature_agrees_with_similarity():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = minhash.signature(x[:900]), minhash.signature(x[100:])
    assert abs((a == b).mean() - 0.8) < 0.12


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}


def test_byte_bpe(odd_docs, no_docs):
    ranks = bpe.read_ranks(MULTI)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r in odd_docs.collect():
        ids = np.array(library.encode_ordinary(r.text or ""), "<u4")
        expected.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert key(bpe.bpe_digest(odd_docs, MULTI, public_tokenizers.PATTERN).collect()) == key(expected)
    assert bpe.bpe_digest(no_docs, MULTI, public_tokenizers.PATTERN).count() == 0
    rows = bpe.decode_documents(bpe.encode_documents(odd_docs, MULTI, public_tokenizers.PATTERN), MULTI, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in rows.collect())


@pytest.mark.parametrize("way", ["_merge_positions", "_merge_buckets"])
def test_rank_queue_ways(way):
    own = bpe.Encoder(bpe.read_ranks(MULTI), public_tokenizers.PATTERN)
    own._merge_positions = own._merge_buckets = getattr(own, way)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = np.random.default_rng(4)
    letters = list("aab bc é\n\t   ,.!'s'll123 \x1c\x85\r東京漢ß")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(1500)] + ["a" * 3000, "ab" * 2000, " " * 500, "the" * 1500]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)


def test_packing(odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, JSON, ranks=RANKS).collect()
    bins = collections.defaultdict(list)
    by = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append(r)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    library = Tokenizer.from_file(JSON)
    for d in odd_docs.collect():
        if d.doc_id in (None, 2):
            continue
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, p in enumerate(sorted(by[d.doc_id], key=lambda r: r.piece)):
            assert (p.piece, p.start) == (k, at) and (p.length == 1024 or k == 0)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert len(by[2]) == 2 * len(by[1]) and len(bins) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack_documents(no_docs, JSON, ranks=RANKS).count() == 0


def test_rank_file_gives_the_library_ids():
    fast = packing.Tokenizer(JSON, RANKS)
    rng = np.random.default_rng(6)
    letters = list("aab bc é\n\t   ,.!'s'll123 \x1c\x85\r東京漢ß")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(2000)] + ["a" * 3000, "", "<|endoftext|> x <|endoftext|>"]
    for t, ids in zip(texts, fast.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == fast.library.encode(t, add_special_tokens=False).ids


def test_special_tokens_are_the_librarys():
    plain = Tokenizer.from_file(JSON)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "no special", "<|endoftext|><|endoftext|> x", "<|endoftext| >"]
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for t, ids in zip(texts, packing.Tokenizer(JSON, RANKS).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_under_all_capacities(rule):
    rng = np.random.default_rng(1)
    histogram = {i: int(n) for i, n in zip(range(1, 1025), rng.integers(0, 20, 1024), strict=True) if n}
    caps = packing.Capacities(1024, 8, 1_100_000)
    runs, n = packing.best_fit(histogram, caps, rule)
    bins = collections.defaultdict(list)
    for r in runs:
        for i in range(r.count):
            bins[r.bin + i].append((r.offset, r.length))
    assert len(bins) == n and sum(map(len, bins.values())) == sum(histogram.values())
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024 and len(held) <= 8 and sum(x * x for _, x in held) <= 1_100_000
    assert n < 1.01 * sum(a * b for a, b in histogram.items()) / 1024 + 1


def test_toxicity(odd_docs, no_docs, some_labels):
    rows = toxicity.toxicity_digest(odd_docs, some_labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.doc_id: r.held_out for r in rows if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1, 14)}
    assert len({r.score for r in rows if r.doc_id in (4, 5, 6)}) == 1 and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert toxicity.toxicity_digest(no_docs, some_labels).count() == 0


def test_toxicity_learns(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(900):
        w = [f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}w" for k in rng.integers(0, 100, rng.integers(5, 120))]
        bad = i % 3 == 0
        if bad:
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(["badworda", "badwordz", "BADWORD,"])))
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity_digest(docs, marks).filter("held_out").collect()
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in got]) > 0.95


def test_pooling_in_parts_is_the_same():
    model = toxicity.Model.new()
    rng = np.random.default_rng(9)
    sizes = [0, 1, 2, 500, 3, 0, 90]
    ids = rng.integers(0, toxicity.BUCKETS, (sum(sizes), toxicity.TABLES)).astype(np.int32)
    at = np.concatenate([[0], np.cumsum(sizes)])
    whole = model.pooled(ids, at)
    assert np.allclose(whole, model.pooled(ids, at, block=64), atol=1e-5)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        x = np.zeros((b - a + 2, toxicity.DIM), np.float32)
        x[: b - a] = model.embed(ids[a:b])
        z = model.convolve(x)[: b - a]
        assert np.allclose(whole[i], np.maximum(z.max(0) + model.bias, 0) if b > a else 0, atol=1e-5)


def test_pipeline(spark, odd_docs, some_labels, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    some_labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        docs = corpus_pipeline.common.written(after, "t")
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    ids = [r.doc_id for r in docs.collect()]
    assert 4 not in ids and 5 not in ids and 8 not in ids and 3 not in ids
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(ids)


def test_decoding_of_many_rows():
    import public_tokenizers

    from sparkloom.llm import bpe

    e = bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["", "a", " leading and  double  spaces ", "Übergröße 漢字 👩‍👩‍👧\n\n x", "word " * 3000, "", "z" * 9000, " a\n b\n\n c \t d"]
    got = e.encode(texts)
    for limit in (4, 64, 1 << 20):
        assert [x.decode() for x in e.decode_all(got, limit)] == texts
    assert list(e.decode_all([])) == [] and list(e.decode_all([b"", b""])) == [b"", b""]
