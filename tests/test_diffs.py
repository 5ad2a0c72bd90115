"""Line differences, patches and merges of many files at once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import diffs


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def edited(rng, lines):
    out = list(lines)
    for _ in range(rng.randint(0, 5)):
        at, kind = rng.randint(0, len(out)), rng.randint(0, 3)
        if kind == 0:
            out[at:at] = [rng.choice("abcx") for _ in range(rng.randint(1, 3))]
        elif kind == 1:
            del out[at : at + rng.randint(1, 3)]
        elif kind == 2 and out:
            out[at : at + 1] = ["y"]
        else:
            cut = rng.randint(0, len(out))
            out = out[cut:] + out[:cut] if rng.random() < 0.3 else out
    return out


def pairs(seed, n=120):
    rng = random.Random(seed)
    old, new = {}, {}
    for i in range(n):
        words = "ab" if i % 3 == 0 else "abcdefgh" if i % 3 == 1 else [f"line {k}" for k in range(60)]
        a = [rng.choice(words) for _ in range(rng.randint(0, 25))]
        old[f"f{i}"], new[f"f{i}"] = "\n".join(a), "\n".join(edited(rng, a))
    old |= {"same": "a\nb\n", "empty": "", "gone": "x\ny", "end": "a\n", "signs": "-- a\n++ b\n@@ c\n \n\t"}
    new |= {"same": "a\nb\n", "empty": "", "end": "a", "fresh": "q", "signs": "-- a\n@@ c\n \n+\n\t"}
    return old, new


def unified_apply(old, patch):
    """A unified text applied with nothing of the library."""
    lines, out, at, left = old.split("\n"), [], 0, (0, 0)
    for line in patch.split("\n")[2:-1]:
        if left == (0, 0):
            a, n, b, m = map(int, re.fullmatch(r"@@ -(\d+),(\d+) \+(\d+),(\d+) @@", line).groups())
            start = a - 1 if n else a
            out, at, left = out + lines[at:start], start, (n, m)
            assert len(out) == (b - 1 if m else b)
            continue
        if line[0] in " -":
            assert lines[at] == line[1:]
        out += [line[1:]] if line[0] in " +" else []
        at += line[0] in " -"
        left = (left[0] - (line[0] in " -"), left[1] - (line[0] in " +"))
    assert left == (0, 0)
    return "\n".join(out + lines[at:])


@pytest.mark.parametrize("seed", [1, 2])
def test_patch_gives_the_copy_back(spark, seed):
    old, new = pairs(seed)
    both = sorted(set(old) & set(new))
    a, b = diffs.numbered(frame(spark, old)), diffs.numbered(frame(spark, new))
    same = diffs.matches(a, b)
    found: dict = {}
    for p, i, j in same.collect():
        found.setdefault(p, []).append((i, j))
    for p in both:
        x, y, m = old[p].split("\n"), new[p].split("\n"), sorted(found.get(p, []))
        assert all(x[i - 1] == y[j - 1] for i, j in m) and all(u[0] < v[0] and u[1] < v[1] for u, v in zip(m, m[1:]))
        if x == y:
            assert len(m) == len(x)
    a, b = (df.filter(F.col("path").isin(both)) for df in (a, b))
    hunks = diffs.hunks(diffs.script(a, b, same=same))
    got = {r["path"]: r["text"] for r in diffs.texts(diffs.patched(a, hunks)).collect()}
    assert got == {p: new[p] for p in both}
    shown = {r["path"]: r["text"] for r in diffs.unified(hunks).collect()}
    assert set(shown) == {p for p in both if old[p] != new[p]}
    for p, text in shown.items():
        assert text.startswith(f"--- {p}\n+++ {p}\n@@ ") and unified_apply(old[p], text) == new[p]


def test_few_lines_change(spark):
    """Edits far apart in lines that repeat: what did not change is found."""
    rng = random.Random(3)
    base = [rng.choice(["a", "b", "c", f"u{i}"]) for i in range(400)]
    new = list(base)
    new[10], new[200], new[390] = "one", "two", "three"
    a, b = diffs.numbered(frame(spark, {"f": "\n".join(base)})), diffs.numbered(frame(spark, {"f": "\n".join(new)}))
    hunks = diffs.hunks(diffs.script(a, b)).orderBy("hunk").collect()
    assert [(h["old_start"], h["old_count"], h["new_start"], h["new_count"]) for h in hunks] == [(8, 7, 8, 7), (198, 7, 198, 7), (388, 7, 388, 7)]
    assert hunks[1]["body"] == [" " + x for x in base[197:200]] + ["-" + base[200], "+two"] + [" " + x for x in base[201:204]]


def test_hunks_that_meet(spark):
    base = [f"l{i}" for i in range(1, 31)]
    new = ["top", *base[:9], "x", *base[10:16], "y", *base[17:]]
    a, b = diffs.numbered(frame(spark, {"f": "\n".join(base)})), diffs.numbered(frame(spark, {"f": "\n".join(new)}))
    hunks = diffs.hunks(diffs.script(a, b)).orderBy("hunk").collect()
    assert [(h["old_start"], h["old_count"], h["new_start"], h["new_count"]) for h in hunks] == [(1, 3, 1, 4), (7, 14, 8, 14)]


def merge(spark, base, ours, theirs):
    row = diffs.merged(spark.createDataFrame([(1, base, ours, theirs)], "id int, base string, ours string, theirs string"), "id").first()
    return row["text"], row["conflicts"]


def test_merge(spark):
    base = "alpha\nbeta\ngamma\ndelta"
    assert merge(spark, base, base.replace("beta", "BETA"), base + "\nepsilon") == ("alpha\nBETA\ngamma\ndelta\nepsilon", 0)
    assert merge(spark, base, base.replace("beta", "BETA"), base.replace("beta", "other")) == ("alpha\nBETA\ngamma\ndelta", 1)
    assert merge(spark, base, "x", base) == ("x", 0)
    assert merge(spark, None, "", None) == ("", 0)


def test_merge_with_one_side_unchanged(spark):
    rng = random.Random(5)
    rows = []
    for i in range(100):
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 8))]
        o = [x for x in b if rng.random() > 0.3]
        rows += [(2 * i, "\n".join(b), "\n".join(o), "\n".join(b), "\n".join(o)), (2 * i + 1, "\n".join(b), "\n".join(b), "\n".join(o), "\n".join(o))]
    df = spark.createDataFrame(rows, "id int, base string, ours string, theirs string, want string")
    assert diffs.merged(df, "id").filter("text <> want or conflicts > 0").count() == 0


def test_lines_once_in_another_order(spark):
    """Of moved lines the longest run stays."""
    a, b = diffs.numbered(frame(spark, {"f": "1\n2\n3\n4\n5"})), diffs.numbered(frame(spark, {"f": "4\n5\n1\n2\n3"}))
    assert sorted(tuple(r)[1:] for r in diffs.matches(a, b).collect()) == [(1, 3), (2, 4), (3, 5)]
