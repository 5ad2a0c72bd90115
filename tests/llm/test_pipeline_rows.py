"""The rows of the whole pipeline against a brute-force version of its five stages; the fitted models are inputs of both."""

import collections
import zlib

import numpy as np
import pyarrow as pa
from test_texts import JSON, brute_components, key, words
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import packing, quality, toxicity

RULES = quality.DecisionList([quality.Rule([quality.Condition("symbols_per_word", True, 0.2)])])


def corpus():
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{k}" for k in rng.integers(0, 5000, n)]
    passage = fresh(70)
    rows, toxic = [], []
    for i in range(90):
        w = fresh(int(rng.integers(30, 260)))
        if i % 6 == 1:
            w[5:5] = passage
        if i % 6 == 2:
            w[3:3] = ["badworda"] * 3
        toxic.append((i, 1, int(i % 6 == 2)))
        if i % 9 == 3:
            w = [x + "#" if j % 3 else x for j, x in enumerate(w)]
        rows.append((i, " ".join(w), "en" if i % 2 else "de"))
    near = rows[5][1].split()
    rows += [(200 + i, " ".join([*near[:i], "other", *near[i + 1 :]]), "en") for i in range(4)]
    rows += [(300, " ".join(fresh(5000)), None), (301, "line\n" * 40, "en"), (302, None, "en"), (303, "", "en"), (304, "few words", "en"), (None, " ".join(fresh(60)), "en"), rows[7], rows[8], (305, rows[7][1], "en")]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], toxic


def good(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w) >= 20 and 100 * len(covered) <= 30 * len(w) and sum(c in "#*$%&|<>" for c in text) < 0.2 * len(w)


def score(model, text):
    ids, _ = toxicity.token_ids(pa.array([text]))
    x = np.zeros((len(ids) + 2, toxicity.DIM), np.float32)
    x[: len(ids)] = model.embed(ids)
    pooled = np.maximum(model.convolve(x)[: len(ids)].max(0) + model.bias, 0) if len(ids) else np.zeros(len(model.bias))
    return 1 / (1 + np.exp(-(pooled.astype(float) @ model.out.astype(float) + model.shift)))


def passages(docs):
    first = {}
    grams = lambda w: [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
    for i, t, *_ in docs:
        for g in grams(words(t)) if i is not None else ():
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t, *_ in docs:
        w = words(t)
        gone = {a + k for a, g in enumerate(grams(w)) if first[g] < i for k in range(50)} if i is not None else set()
        out.append((i, " ".join(x for a, x in enumerate(w) if a not in gone) if gone else t))
    return out


def test_run_equals_brute_force(spark, tmp_path, monkeypatch):
    docs, marks = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.fit(frame, labels)
    monkeypatch.setattr(corpus_pipeline.quality, "fit", lambda *_: RULES)
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda *_: model)
    sizes = [len(docs)]
    kept = [d for d in docs if good(d[1] or "")]
    sizes.append(len(kept))
    kept = [d for d in kept if score(model, d[1]) < model.thresholds.get(d[2], toxicity.CUT)]
    sizes.append(len(kept))
    rows = spark.createDataFrame(kept, frame.schema).collect()
    gone = {i for i, _, least, _ in brute_components(rows, 5) if least != i}
    kept = [d for d in kept if d[0] not in gone]
    sizes.append(len(kept))
    cut = passages(kept)
    assert sizes == sorted(set(sizes), reverse=True) and sum(a[1] != b[1] for a, b in zip(kept, cut, strict=True)) > 3  # every stage has work
    library = Tokenizer.from_file(JSON)
    expected = []
    for i, t in cut:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or 1024
        ends = range(head, len(ids) + 1, 1024)
        expected += [(i, k, max(0, b - 1024), b - max(0, b - 1024), zlib.crc32(ids[max(0, b - 1024) : b].tobytes())) for k, b in enumerate(ends)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == key(expected)
    runs, _ = packing.best_fit(dict(collections.Counter(r[3] for r in expected)), corpus_pipeline.CAPACITIES)
    assert sorted((r.length, r.sequence_id, r.offset) for r in got) == sorted((r.length, r.bin + k, r.offset) for r in runs for k in range(r.count))


def test_empty_table(spark, no_docs):
    """Every stage of a table without rows, and with columns named as the operators' own."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, no_docs, "/root/testdata/sf0.001")
        assert out.count() == 0, name
        assert name == "packing" or out.columns == no_docs.columns, name
