"""Scores of whole texts against the definition, word by word, and the model's way through Spark."""

import pickle
import re

import numpy as np

from sparkloom.llm import toxicity
from sparkloom.llm import words as W


def labelled(spark):
    rng = np.random.default_rng(4)
    plain, bad = [f"plain{i}" for i in range(300)], ["slurone", "slurtwo", "slurthree"]
    docs, labels = [], []
    for i in range(400):
        w = rng.choice(plain, int(rng.integers(5, 60))).tolist()
        if i % 3 == 0:
            w.insert(int(rng.integers(0, len(w))), bad[i % 9 // 3])
        docs.append((i, " ".join(w), "en" if i % 2 else "de"))
        labels.append((i, int(i % 3 == 0)))
    docs += [(1000, None, None), (1001, "", "en"), (1002, "1 2 3", None), (None, "slurone plain1", "en"), (1003, "slurtwo " + "plain2 " * 80_000, "en"), docs[0]]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


def score(model, text):
    """By the definition: every filter at every place of the text, with zeros beyond its end."""
    raw = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())
    ids = []
    for word in raw:
        one = np.frombuffer(word, np.uint8)
        hashes = W.hash_prefixes(one, np.array([0]), [np.array([n]) for n in (len(one), min(4, len(one)), min(5, len(one)), min(6, len(one)))], toxicity._LOWER)
        ids.append([int(h[0]) % toxicity.BUCKETS for h in hashes])
    x = [sum(model.embedding[t, i] for t, i in enumerate(row)) for row in ids] + [np.zeros(toxicity.DIM, np.float32)] * 2
    pooled = np.zeros(toxicity.FILTERS * len(toxicity.WIDTHS))
    for f, kernel in enumerate(model.kernels):
        for c in range(toxicity.FILTERS if ids else 0):
            best = max(sum(float(x[p + k] @ kernel[k][:, c]) for k in range(len(kernel))) for p in range(len(ids)))
            pooled[f * toxicity.FILTERS + c] = max(0.0, best + float(model.bias[f * toxicity.FILTERS + c]))
    return 1 / (1 + np.exp(-(pooled @ model.out + model.shift)))


def test_scores_by_definition(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    again = pickle.loads(pickle.dumps(model))
    assert np.array_equal(again.embedding, model.embedding) and len(pickle.dumps(model)) < model.embedding.nbytes / 4
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.text is None or len(r.text) < 2000:
            assert abs(r.score - score(model, r.text)) < 1e-5
    assert next(r.score for r in rows if r.doc_id == 1003) >= toxicity.CUT  # its first word counts as much as all others
    got = toxicity.toxicity_digest(docs.drop("lang"), labels).collect()
    assert all(r.predicted == int(r.score >= toxicity.CUT) and r.lang_threshold == toxicity.CUT for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(held) > 50 and sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
