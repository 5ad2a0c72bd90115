"""Merges and edits with a file's lines in its row: the same as by lines, of which only those between equal ends are dealt out."""

import random

from pyspark.sql import functions as F
from test_diffs import edited

from sparkloom.operators import diffs, edits


def test_merges_are_those_by_lines(spark):
    rng, rows = random.Random(4), []
    for i in range(40):
        base = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 20))]
        rows.append((i, base, edited(rng, base) or ["z"], edited(rng, base) or ["z"]))
    rows += [(100, ["a", "b", "c"], ["a", "b", "C"], ["A", "b", "c"]), (101, ["a", "a", "a"], ["a", "a"], ["x", "a", "a"]), (102, ["a"], ["b"], ["c"])]
    files = spark.createDataFrame(rows, "id int, base array<string>, ours array<string>, theirs array<string>")
    side = lambda c: files.select("id", F.posexplode(c).alias("n", "text")).withColumn("n", F.col("n") + 1)
    lines, conflicts = diffs.merge_lines(side("base"), side("ours"), side("theirs"), "id")
    texts = {r.id: r.text for r in diffs.texts(lines, "id").collect()}
    want = sorted((r.id, texts.get(r.id, ""), r.conflicts) for r in conflicts.collect())
    got = sorted((r.id, "\n".join(r.lines), r.conflicts) for r in diffs.merged_lines(files, "id").collect())
    assert got == want and {c > 0 for _, _, c in got} == {True, False}


def test_hunks_in_a_row(spark):
    files = spark.createDataFrame([(p, [f"{p}{i}" for i in range(1, 8)]) for p in "ab"] + [("c", [])], "path string, lines array<string>")
    rows = [("a", 0, "replace", 2, 4, ["x", "y"]), ("a", 1, "insert_after", 3, 3, ["in"]), ("a", 2, "insert_before", 6, 6, ["p", "q"]), ("a", 3, "insert_after", 6, 6, ["r"]), ("a", 4, "cut", 7, 7, []), ("a", 5, "eof", 0, 0, ["end"]), ("a", 6, "bof", 0, 0, ["top"]), ("a", 7, "insert_before", 6, 6, ["s"]), ("c", 0, "bof", 0, 0, ["one"]), ("c", 1, "eof", 0, 0, ["two"])]
    hunks = spark.createDataFrame(rows, "path string, seq int, action string, start int, end int, body array<string>")
    lines = files.select("path", F.posexplode("lines").alias("line", "text")).withColumn("line", F.col("line") + 1)
    want: dict = {}
    for r in edits.apply_hunks(lines, hunks).orderBy("path", "line").collect():
        want.setdefault(r.path, []).append(r.text)
    done = files.join(edits.changes_of(hunks), "path", "left").select("path", edits.applied(F.col("lines"), "changes").alias("lines"))
    assert {r.path: r.lines for r in done.collect()} == want
