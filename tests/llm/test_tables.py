"""Operators on vectors, pages and conversations against brute force, with odd rows, and on empty tables."""

import base64
import collections
import gzip
import hashlib
import json
import math
from pathlib import Path

import numpy as np
import pytest

from sparkloom.llm import html_text, queries, tool_calls, topk, warc


def key(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def brute_top(rows, k):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for i, q in ints:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ints if j != i and len(v) == len(q))
            out += [(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)]
    return key(out)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(1000, 1060)] + [rows[0], rows[5]]  # ties, repeats
    rows += [(None, rows[1][1]), (2001, None), (2002, [1.0, None]), (2003, [float("nan")] * 8), (2050, [float("inf")] * 8), (2100, []), (2150, [0.5, 0.25])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int").repartition(3)
    assert key(topk.topk_digest(df).collect()) == brute_top(rows, 5)
    assert topk.topk_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [40, 2**27])
def test_bounds_find_the_same_as_reading_all(scale):
    rng = np.random.default_rng(2)
    x, ids = rng.integers(-scale, scale, (800, 6)), rng.permutation(800)
    found = topk.block_top_k(x[:40], ids[:40], x, ids, 5, few=20)
    for i, (at, score) in enumerate(found):
        exact = x.astype(object) @ x[i].astype(object)
        order = [j for j in sorted(range(800), key=lambda j: (-exact[j], ids[j])) if ids[j] != ids[i]][:5]
        assert at.tolist() == order and score.tolist() == [exact[j] for j in order]


PAGE = '<!DOCTYPE html><html><head><title>t</title><script>var a="</p><article>";</script></head><body class="p{0}"><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad">buy</div>{1}<div id="comments"><p>nice post</p></div><footer>&copy; x</footer></body></html>'


def test_html(spark):
    body = "<article><h1>Head &amp; line</h1><p><b>One<br>two<p>Three\n  four, five, six, seven</p><ul><li>a<li>b</ul><!-- <p>no</p> --><form><p>sign up</p></form></article>"
    expected = "Head & line\nOne two\nThree four, five, six, seven\na\nb"
    plain = '<div class="story s12"><p>' + "long text, " * 30 + "</p></div>"
    rows = [(1, "http://h/a", PAGE.format(1, body)), (2, "http://h/b", PAGE.format(2, body)), (3, "http://k/b", PAGE.format(3, plain)), (4, None, None), (5, "x", ""), (6, "http://h/c", "plain <b>text"), (2, "http://h/b", PAGE.format(2, body)), (None, "http://u@H:80/", PAGE.format(1, body)[:-200])]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_pages(df).collect()}
    assert got[1].text == expected and got[2].text == expected and got[1].n_chars == len(expected)
    assert got[3].text == " ".join(("long text, " * 30).split())
    assert got[4].text == "" and got[5].text == "" and got[6].text == "plain text"
    assert html_text.extract_pages(df).count() == len(rows) and html_text.extract_pages(df.limit(0)).count() == 0
    hosts = {r.host: r.paths for r in html_text.host_paths(df).collect()}
    assert hosts["h"][0] == "html>body.p#>article" and hosts["k"] == ["html>body.p#>div.s#.story"]


def test_long_page_is_whole():
    text = "".join(f"<p>paragraph {i}, with words</p>" for i in range(20000))
    assert html_text.extract(f"<body><article>{text}</article></body>", []).count("\n") == 19999


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/ b", "same"), (2, "u", "same"), (3, None, None), (4, "v", ""), (None, "w", "same"), (None, "q", "alone"), (5, "z", "x" * 300_000), (2, "u", "same"), (6, "é", "ünï")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload string").repartition(2)
    by = collections.defaultdict(list)
    for i, _, h in rows:
        by[h or ""].append(i)
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        most = max((x for x in by[h or ""] if x is not None), default=None)
        own = most is None or i == most
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else most))
    assert key(warc.warc_digest(df).collect()) == key(expected)
    assert warc.warc_digest(df.limit(0)).count() == 0
    path = str(tmp_path / "archive")
    warc.write_pages(df, path, least=5)
    full = warc.read_archives(spark, path)
    assert full.filter("record_type = 'revisit'").count() == 0  # the equal payloads are shorter
    assert {r.page_id: bytes(r.payload).decode() for r in full.filter("page_id is not null").collect()} == {i: h or "" for i, _, h in rows if i is not None}
    digest = base64.b32encode(hashlib.sha1(b"alone").digest()).decode()
    picked = warc.read_archives(spark, path, where={"record_type": "response", "payload_digest": digest, "target_uri": "q%", "page_id": None})
    assert [bytes(r.payload) for r in picked.collect()] == [b"alone"]
    plan = picked._jdf.queryExecution().optimizedPlan().toString()
    assert "payload_digest" not in "".join(line for line in plan.split("\n") if "Filter" in line and "isnotnull" not in line)
    assert picked.filter("record_type = 'revisit'").count() == 0 and picked.count() == 1
    assert full.filter(f"payload_digest = '{digest}'").count() == 1 and full.count() == len(rows)
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in Path(path).glob("*.gz"))
    (tmp_path / "plain.warc").write_bytes(raw)
    (tmp_path / "other.warc.gz").write_bytes(b"".join(gzip.compress(b"WARC/1.1" + r) for r in raw.split(b"WARC/1.1")[1:]))
    for other in ("plain.warc", "other.warc.gz"):
        assert key(warc.read_archives(spark, str(tmp_path / other)).collect()) == key(full.collect())


def test_filters_reach_the_archive():
    reader = warc.WarcReader("x", None, '[["record_type", "eq", "\\"response\\""], ["page_id", "in", "[1, 2]"]]')
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("http_length",), 3), IsNull(("refers_to",)), In(("page_id",), (2, 1))]))
    assert [type(f) for f in left] == [GreaterThan, IsNull] and len(reader.filters) == 2


TOOLS = {"add": tool_calls.Tool({"a": "integer", "b": "number", "tags": "array"}, frozenset({"a", "b"}))}


def test_tool_calls(spark):
    calls = [
        (1, 0, "x", "add", '{"b":2.5,"a":1}', []), (1, 1, "y", "add", '{"a":"1"}', ["x"]), (1, 2, "z", "add", "[1]", ["y", "x", "gone"]), (1, 3, "c1", "add", "{", ["c2"]), (1, 4, "c2", "sub", "{}", ["c1"]),
        (2, 0, "x", "add", None, None), (1, 5, "x", "add", '{"a":9,"b":9}', []), (None, 0, "n", "add", "{}", []), (3, 0, None, "add", "{}", []), (1, 6, "after", "add", '{"a":1,"b":1,"tags":[{"k":1,"j":2}]}', ["c1"]),
    ]
    results = [(1, 2, "x", 'say "é"\n'), (1, 3, "x", "later"), (1, 9, "w", "orphan"), (2, 1, "x", None), (None, 1, "x", "n")]
    c = spark.createDataFrame(calls, "conv_id long, turn int, call_id string, name string, arguments string, depends_on array<string>")
    r = spark.createDataFrame(results, "conv_id long, turn int, call_id string, content string")
    rows = {(x.conv_id, x.call_id): x for x in tool_calls.link(c, r, TOOLS).collect()}
    assert len(rows) == 7
    assert {k: v.level for k, v in rows.items()} == {(1, "x"): 0, (1, "y"): 1, (1, "z"): 2, (1, "c1"): None, (1, "c2"): None, (1, "after"): None, (2, "x"): 0}
    assert rows[1, "x"].json == '{"arguments":{"a":1,"b":2.5},"id":"x","name":"add","result":"say \\"é\\"\\n"}' and rows[1, "x"].n_results == 2 and rows[1, "x"].valid
    assert rows[1, "y"].errors == ["a is no integer", "missing b"] and rows[1, "z"].errors == ["arguments are no object"]
    assert rows[1, "c1"].errors == ["arguments are no JSON"] and rows[1, "c2"].errors == ["unknown tool"] and not rows[1, "y"].linked
    assert rows[1, "after"].valid and json.loads(rows[1, "after"].json)["arguments"]["tags"] == [{"j": 2, "k": 1}]
    assert [x.call_id for x in tool_calls.orphans(c, r).filter("conv_id is not null").collect()] == ["w"]
    assert tool_calls.link(c.limit(0), r.limit(0), TOOLS).count() == 0


def test_tool_call_query_on_odd_messages(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 2, "user", "q"), (1, 2, "user", "p"), (1, 3, None, "x"), (None, 0, "user", "n"), (2, None, "user", "m"), (3, 1, "user", ""), (4, 1, "assistant", "o")]
    got = tool_calls.tool_call_digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert key((r.conv_id, r.turn, r.level, r.linked, r.valid) for r in got) == key([(1, 0, 0, True, False), (1, 2, 1, False, True), (3, 1, 0, False, True)])


def test_queries_equal_their_sql(spark):
    import oracle

    sf = "/root/testdata/sf0.001"
    db = oracle.duck(sf)
    for name, sql in queries.ORACLE_SQL.items():
        assert oracle.difference(spark, db, queries.QUERIES[name], sql, sf) is None, name
