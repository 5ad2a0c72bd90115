"""Operators whose inputs the driver's tables do not have: edits, merges, scans, policies, streams, transactions."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.operators import edits, graph, history, intervals, policy, requests, search, sessions
from sparkloom.plans import steps
from sparkloom.sources import tree
from sparkloom.streaming import changes

# Policies


@pytest.mark.parametrize(
    ("pattern", "deny", "op", "expected"),
    [
        ("context.read", False, "context.read", True), ("context.read", False, "context.read.x", False), ("context.read", False, "context.reader", False), ("context.", False, "context.read", True),
        ("context.", False, "context", False), ("context.", False, "contextual.read", False), ("context.", False, "context.a.b", True), ("mutate", True, "mutate", True), ("mutate", True, "mutate.edit", True),
        ("mutate", True, "mutated", False), ("mutate.", True, "mutate", False), ("mutate.", True, "mutate.edit", True), ("mutate", False, "mutate.edit", False), ("context.", False, "context.", False),
    ],
)
def test_pattern(pattern, deny, op, expected):
    taken = not policy.Policy.of([], [pattern]).permits(op) if deny else policy.Policy.of([pattern]).permits(op)
    assert taken is expected


@pytest.mark.parametrize("bad", ["", ".", " ", "a b", "\t", "a\n"])
def test_bad_pattern(bad):
    with pytest.raises(ValueError):
        policy.Policy.of([bad])


def test_narrowing_never_permits_more():
    rng = random.Random(2024)
    names = ["a", "a.", "a.b", "a.b.", "a.b.c", "b", "b.", "c.d"]
    ops = ["a", "a.b", "a.b.c", "a.b.c.d", "a.x", "b", "b.y", "c.d", "c.d.e", "z"]
    accepted = 0
    for _ in range(20000):
        p, q = (policy.Policy.of(rng.sample(names, rng.randint(0, 3)), rng.sample(names, rng.randint(0, 2))) for _ in range(2))
        if q.narrows(p):
            accepted += 1
            assert all(p.permits(o) for o in ops if q.permits(o))
    assert accepted > 500


def test_enforcement_only_narrows():
    requests = [None, *policy.PROFILES.values()]
    ops = [*policy.READ_OPS, *policy.CHECK_OPS, *policy.MUTATE_OPS, *policy.OBSERVE_OPS]
    for sequence in itertools.product(requests, repeat=3):
        active = None
        for request in sequence:
            after, _ = policy.advance(active, request)
            if active is not None:
                assert after is not None and all(active.permits(o) for o in ops if after.permits(o))
            active = after


def test_stored_policy():
    assert policy.stored(None) is None and policy.stored("{") is policy.LOCKDOWN and policy.stored('{"allow": []}') is policy.LOCKDOWN
    assert policy.stored('{"allow": ["a."], "deny": []}').permits("a.b")


# Texts and edits


def test_text_functions(spark):
    df = spark.createDataFrame([("a \r\nb\t\n", "src/x.rs", "a,4-2,x,7-9"), ("a\nb\n", ".rs", ""), ("﻿x", "d/Makefile", "3")], "t string, p string, s string")
    rows = df.select(
        X.tag(X.normalize_lf(F.col("t"))).alias("tag"), X.language_of_path(F.col("p")).alias("lang"), X.is_indexable(F.col("p")).alias("ok"), X.strip_bom(F.col("t")).alias("bom"),
        intervals.seen_text(intervals.seen_ranges(F.col("s"))).alias("seen"), X.last_segments(F.lit("a::b::c")).alias("two"), X.strip_generics(F.lit("&'a mut Vec<u8>")).alias("bare"), X.dyn_trait(F.lit("Box<dyn a::Speak>")).alias("dyn"),
    ).collect()
    assert rows[0].tag == rows[1].tag and [r.lang for r in rows] == ["rust", "rust", None] and [r.ok for r in rows] == [True, True, False]
    assert rows[2].bom == "x" and [r.seen for r in rows] == ["4,7-9", "", "3"] and rows[0].two == "b::c" and rows[0].bare == "Vec" and rows[0].dyn == "Speak"


def test_outline_and_marks(spark):
    lines = spark.createDataFrame([("f", i, f"l{i}") for i in range(1, 13)], "path string, line int, text string")
    spans = spark.createDataFrame([("f", 1, 3, "short"), ("f", 5, 12, "long_body"), ("f", 6, 12, "inner")], "path string, start int, end int, name string")
    got = {r.line: (r.text, r.folded) for r in search.outline(lines, spans).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and got[6] == ("6-12: … (long_body)", True) and got[5] == ("l5", False)


def compiled(spark, steps, symbols=(), spans=()):
    """Sections, hunks and faults of one request on the file f."""
    body = json.dumps({"path": "f", "tag": "abcd", "edits": steps})
    names = spark.createDataFrame(list(symbols), "file string, name string, qualified string, kind string, start_line int")
    return requests.compiled(spark.createDataFrame([(1, body)], "req long, body string"), names, spark.createDataFrame(list(spans), "file string, start int, end int"))


def test_edits(spark):
    text = "alpha\nbeta\ngamma\ndelta"
    lines = X.lines(spark.createDataFrame([("f", text)], "path string, text string"))
    steps = [{"replace": {"lines": [2, 3]}, "with": "B\nC"}, {"insert": {"after": "$"}, "body": "end"}, {"insert": {"before": "^"}, "body": "top"}, {"delete": {"symbol": "d"}}]
    _, hunks, faults = compiled(spark, steps, [("f", "d", "x.d", "fn", 4)], [("f", 4, 4)])
    assert faults.count() == 0
    hunks = hunks.select("path", "seq", "action", "start", "end", "body")
    assert edits.joined(edits.apply_hunks(lines, hunks)).first().text == "top\nalpha\nB\nC\nend\n"
    seen = spark.createDataFrame([("f", 1, 3)], "path string, start int, end int")
    bad = spark.createDataFrame([("f", 0, "replace", 2, 9, ["x"]), ("f", 1, "cut", 3, 4, []), ("f", 2, "cut", 4, 4, [])], hunks.schema)
    reasons = {(r.line, r.reason) for r in edits.refused(lines, bad, seen).collect()}
    assert {(2, "out of bounds"), (3, "overlap"), (4, "overlap"), (4, "not shown")} <= reasons
    assert edits.refused(lines, hunks).count() == 0


@pytest.mark.parametrize(
    "bad", [{"action": "x"}, {"replace": {"lines": [0, 1]}, "with": ""}, {"replace": {"symbol": "no"}, "with": ""}, {"insert": {"before": 0}, "body": ""}, {"replace": {"lines": [3, 2]}, "with": ""}, {"replace": {"lines": [1, 2]}}]
)
def test_refused_steps(spark, bad):
    fine = {"replace": {"lines": [1, 1]}, "with": "x"}
    sections, hunks, faults = compiled(spark, [fine, bad])
    assert [(r["req"], r["section"], r["seq"]) for r in faults.collect()] == [(1, 0, 1)]
    assert sections.count() == hunks.count() == 0


def test_history(spark):
    rows = spark.createDataFrame([("p", "abcd" + "0" * 60, 0, 100), ("p", "abcd" + "1" * 60, 1, None), ("q", "ffff" + "0" * 60, 0, 200)], "path string, tag string, revision int, saved_at long")
    page, total, offset = history.history(rows, arg="p", most=1)
    assert (total, offset, page.first().saved_at) == (2, 1, 100)
    assert history.history(rows, since=101)[1] == 1 and history.history(rows, tag="ABCD")[1] == 2
    for wrong in ({"most": 0}, {"offset": -1}, {"since": 2, "until": 1}, {"tag": "xyz"}):
        with pytest.raises(ValueError):
            history.history(rows, **wrong)
    assert history.resolve(rows, "abcd")[0] == "ambiguous" and history.resolve(rows, "ffff")[0] == "found" and history.resolve(rows, "eeee")[0] == "missing"
    objects = spark.createDataFrame([("t", "a", 1)], "tag string, content string, saved_at long")
    assert {(r.tag, r.content) for r in history.put(objects, spark.createDataFrame([("t", "b", 2), ("u", "c", 3)], objects.schema)).collect()} == {("t", "b"), ("u", "c")}


def test_path_and_cycle(spark):
    edge = lambda a, b, c="direct": (a, b, "call", c, "")
    e = spark.createDataFrame([edge("a", "b"), edge("b", "c", "name"), edge("c", "a"), edge("x", "b", "dyn")], "src string, dst string, kind string, confidence string, detail string")
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    path = lambda a, b: [tuple(r)[1:] for r in sorted(graph.call_path(e, a, b).collect())]
    assert path(one("a"), one("c")) == [("a", ""), ("b", "direct"), ("c", "name")]
    assert path(one("a"), one("a", "c")) == [("a", "")] and path(one("a"), one("zz")) == []
    ways = spark.createDataFrame([("c", "zz"), ("b", "x"), ("a", "c"), ("a", "a")], "a string, b string")
    assert {tuple(r) for r in graph.path_directions(e, ways).collect()} == {("c", "zz", None, False), ("b", "x", None, True), ("a", "c", 2, False), ("a", "a", 0, False)}
    around = graph.blast_radius(e.filter("confidence <> 'name'"), spark.createDataFrame([("b",)], "start string"))
    assert {(r.id, r.hops, r.dyn) for r in around.collect()} == {("a", 1, False), ("x", 1, True), ("c", 2, False)}


def test_hint_everywhere(spark):
    rows = [(n * 1000 + sum(b << k for k, b in enumerate(bits)), i, bool(b)) for n in range(1, 8) for bits in itertools.product((0, 1), repeat=n) for i, b in enumerate(bits)]
    df = spark.createDataFrame(rows, "s long, seq int, solo boolean")
    got = {r.s: r.hint_at for r in sessions.hint_first(df, ["s"], [F.col("seq")], F.col("solo")).collect()}
    expected = {}
    for n in range(1, 8):
        for bits in itertools.product((0, 1), repeat=n):
            at = next((i + 1 for i in range(2, n) if bits[i - 2 : i + 1] == (1, 1, 1)), None)
            if at:
                expected[n * 1000 + sum(b << k for k, b in enumerate(bits))] = at
    assert got == expected


# Scans, streams, transactions


def test_tree(spark, tmp_path):
    files = {"src/a.rs": "fn a() {}\r\n", "node_modules/x.js": "no", "env/pyvenv.cfg": "home = x", "env/lib/b.py": "no", "skipme/c.py": "no", "big.rs": "x" * 5000, "d/e.bin": "no", "README.md": "# T", ".gitignore": "skipme/\n*.log\n!x\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    rows, counts = tree.scan(spark, str(tmp_path), max_bytes=1000)
    got = {r.path: r.text for r in rows.collect()}
    assert got == {"src/a.rs": "fn a() {}\n", "README.md": "# T"} and tuple(counts.first()) == (2, 1)
    with pytest.raises(ValueError):
        tree.scan(spark, "/")
    names = spark.createDataFrame([("package.json",), ("go.mod",), ("x",)], "path string")
    assert tree.markers(names).first().marker == "go.mod"


def stream_of(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).coalesce(1).write.json(path)
    return spark.readStream.schema(schema).json(path)


def run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streamed_hint_and_changes(spark, tmp_path):
    rows = [("a", i, i in (1, 2, 3, 7)) for i in range(9)] + [("b", i, i % 3 != 0) for i in range(9)]
    events = stream_of(spark, tmp_path, rows, "s string, seq int, solo boolean")
    assert [tuple(r) for r in run(spark, changes.hints(events, "s", "solo"), tmp_path, "hints")] == [("a", 4)]
    got = {}
    schema = "path string, text string, seq int"
    spark.createDataFrame([("x", "1", 0), ("x", "2\r\n", 1), ("y", "3", 0), ("z", None, 0)], schema).coalesce(1).write.json(str(tmp_path / "changes"))
    base = spark.createDataFrame([("z", "old", "t"), ("w", "kept", "t2")], "path string, text string, tag string")
    follow = changes.follow(spark.readStream.schema(schema).json(str(tmp_path / "changes")), lambda batch, _: got.update({r.path: r.text for r in changes.refreshed(base, batch).collect()}), str(tmp_path / "c"))
    follow.awaitTermination()
    assert got == {"x": "2\n", "y": "3", "w": "kept"}


def test_streamed_debounce_equals_batch(spark, tmp_path):
    rows = [("u", f"2024-01-01 00:00:{s:06.3f}", w) for s, w in ((0, "a"), (0.2, "b"), (0.5, "a"), (2, "c"), (9, "d"))] + [("end", "2024-01-02 00:00:00.000", "z")]
    events = stream_of(spark, tmp_path, rows, "user string, ts timestamp, what string")
    got = run(spark, changes.debounced(events, "user", gap="300 milliseconds", late="1 second", what="what"), tmp_path, "batches")
    assert sorted((r.n, r.what) for r in got if r.user == "u") == [(1, ["c"]), (1, ["d"]), (3, ["a", "b"])]
    batch = sessions.debounce(spark.createDataFrame(rows, "user string, ts string, what string").withColumn("ts", F.to_timestamp("ts")), ["user"], "ts", "300 milliseconds")
    assert sorted((r.start, r.end, r.n) for r in batch.filter("user = 'u'").collect()) == sorted((r.start, r.end, r.n) for r in got if r.user == "u")


def test_subscriptions(spark):
    events = spark.createDataFrame([(1, "k1", "w1"), (2, "k2", None), (3, "k1", "w2")], "seq int, kind string, workspace string")
    subs = spark.createDataFrame([("s1", ["k1"], ["w1"]), ("s2", ["k1", "k2"], []), ("s3", ["k2"], ["w9"])], "session string, kinds array<string>, workspaces array<string>")
    assert sorted((r.seq, r.session) for r in changes.subscribed(events, subs).collect()) == [(1, "s1"), (1, "s2"), (2, "s2"), (2, "s3"), (3, "s2")]


def test_transactions(spark):
    first = spark.createDataFrame([("a", "1")], "path string, text string")
    store = steps.Snapshots(spark, first)
    create = lambda df: edits.create(df, spark.createDataFrame([("b", "2")], first.schema))[0]
    steps.transaction(store, [create])
    assert {tuple(r) for r in store.read().collect()} == {("a", "1"), ("b", "2\n")}

    def fail(df):
        raise RuntimeError("step")

    with pytest.raises(RuntimeError):
        steps.transaction(store, [lambda df: edits.delete(df, df.select("path"))[0], fail])
    with pytest.raises(ValueError):
        steps.transaction(store, [lambda df: df.limit(0)], validate=lambda df: df.count() > 0)
    assert store.read().count() == 2
    store.restore(0)
    assert store.read().count() == 1
    macros = steps.Macros()
    macros.save("m", [{"op": "x", "n": 2}])
    assert macros.names() == ["m"] and steps.run({"x": lambda n: n * 2}, macros.steps("m")) == [4]
    with pytest.raises(ValueError):
        macros.save("../m", [])
    assert json.loads(macros.stored["m"])


def test_many_paths_at_once(spark):
    """Every pair of a random graph against a search by definition; long chains too."""
    rng = random.Random(8)
    edges = {(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}"): rng.choice(["direct", "dyn", "name"]) for _ in range(45)} | {(f"c{i}", f"c{i + 1}"): "direct" for i in range(20)}
    df = spark.createDataFrame([(a, b, "call", c, "") for (a, b), c in edges.items()], "src string, dst string, kind string, confidence string, detail string")
    pairs = [(f"n{i}", f"n{j}") for i in range(0, 26, 3) for j in range(26)] + [("c0", "c20"), ("c20", "c0"), ("c3", "c9")]
    expected = {}
    for a, b in pairs:
        level, parent = [a], {a: None}
        while level and b not in parent:
            fresh: dict = {}
            for x in sorted(level, reverse=True):
                fresh |= {d: x for s, d in edges if s == x and d not in parent}
            parent |= fresh
            level = list(fresh)
        path = [b] if b in parent else []
        while path and parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        expected[a, b] = path[::-1]
    got: dict = {p: [] for p in pairs}
    for a, b, hop, i, confidence in sorted(graph.call_paths(df, spark.createDataFrame(pairs, "a string, b string")).collect()):
        got[a, b].append(i)
        assert hop == len(got[a, b]) - 1 and confidence == (edges[got[a, b][-2], i] if hop else "")
    assert got == expected
