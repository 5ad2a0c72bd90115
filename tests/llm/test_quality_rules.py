"""The learned list on whole documents: what Spark's expressions decide against the rules read in Python."""

import collections
import re

import numpy as np

from sparkloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark):
    rng = np.random.default_rng(12)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "ne", "tu") for b in ("van", "sil", "dor", "kem", "pos", "gar")]
    docs, labels = [], []
    for i in range(600):
        w = rng.choice(words, int(rng.integers(25, 120))).tolist()
        bad = i % 4 == 0
        if bad:
            w = [x.upper() + "!" if k % 2 else x + "#" for k, x in enumerate(w)] if i % 8 else [x + str(i * 37 + k) for k, x in enumerate(w)]
        docs.append((i, " ".join(w) if i % 3 else "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))))
        labels.append((i, int(not bad)))
    docs += [(900, None), (901, ""), (902, "few words"), (903, "one two three four five six seven eight " * 20), (None, docs[1][1]), docs[2]]
    return docs, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")


def features(text):
    t = text or ""
    w = WORD.findall(t)
    chars = sum(map(len, w))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeat = len({i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)})
    share = lambda a, b: a / b if b else 0.0
    return {
        "chars_per_word": share(chars, len(w)), "symbols_per_word": share(sum(c in "#*$%&|<>" for c in t), len(w)), "repeat_share": share(repeat, len(w)), "dup_line_share": share(len(lines) - len(set(lines)), len(lines)),
        "upper_share": share(sum("A" <= c <= "Z" for c in t), chars), "digit_share": share(sum("0" <= c <= "9" for c in t), chars), "mark_share": share(sum(c in "!?" for c in t), chars), "words_per_line": share(len(w), len(lines)),
    }, len(w) < 20 or 100 * repeat > 30 * len(w)


def first_rule(rules, x):
    for k, rule in enumerate(rules.rules, 1):
        if all(x[c.feature] >= c.threshold if c.above else x[c.feature] <= c.threshold for c in rule.conditions):
            return k
    return 0


def test_list_decides_as_read(spark):
    docs, frame, labels = corpus(spark)
    rules = quality.fit(frame, labels)
    assert rules.rules and str(rules.rules[0])
    expected = []
    for i, t in docs:
        x, base = features(t)
        k = first_rule(rules, x)
        expected.append((i, base, k, not base and k == 0))
    got = [(r.doc_id, r.base_failed, r.rule, r.kept) for r in quality.quality_digest(frame, labels).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    kept = {i for i, _, _, yes in got if yes and i is not None and i < 600}
    good = {i for i in range(600) if i % 4}
    assert len(kept & good) >= 0.95 * len(good) and len(kept - good) <= 0.1 * 150
