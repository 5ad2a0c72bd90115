"""Nested schemas, and one form for every number."""

import json

from sparkloom.llm import tool_calls

TOOL = tool_calls.Tool(
    {
        "n": "integer", "unit": {"type": "string", "enum": ["m", "km"]}, "tags": {"type": "array", "items": {"type": "string"}},
        "at": {"type": "object", "properties": {"x": "number", "y": "integer"}, "required": ["x"], "additionalProperties": False},
        "rows": {"type": "array", "items": {"type": "object", "properties": {"k": "integer"}, "required": ["k"]}}, "level": {"enum": [1, 2.5, None]},
    },
    frozenset({"n"}), others=False,
)
CASES = [
    ({"n": 1, "unit": "km", "tags": ["a"], "at": {"x": 1.5, "y": 2}, "rows": [{"k": 1}]}, []),
    ('{"n":1.0}', []), ('{"n":1e2}', []), ('{"n":1.5}', ["n is no integer"]), ('{"n":"1"}', ["n is no integer"]), ({}, ["missing n"]),
    ({"n": 1, "unit": "mile"}, ["unit is none of its values"]), ({"n": 1, "tags": ["a", 1]}, ["tags has a wrong item"]), ({"n": 1, "tags": "a"}, ["tags is no array"]),
    ({"n": 1, "at": {"y": 1, "z": 0}}, ["missing at.x", "at have further properties"]), ({"n": 1, "at": {"x": "1"}}, ["at.x is no number"]),
    ({"n": 1, "rows": [{"k": 1}, {}]}, ["rows has a wrong item"]), ({"n": 1, "more": 0}, ["arguments have further properties"]), ({"n": 1, "level": 2.5}, []), ({"n": 1, "level": 3}, ["level is none of its values"]),
]


def linked(spark, texts):
    rows = [(1, i, str(i), "go", t, []) for i, t in enumerate(texts)]
    calls = spark.createDataFrame(rows, "conv_id long, turn int, call_id string, name string, arguments string, depends_on array<string>")
    calls = calls.selectExpr("*", "'x' as level", "0 as v", "'y' as errors", "1 as root")  # names that the operator uses itself
    results = spark.createDataFrame([], "conv_id long, turn int, call_id string, content string")
    return {r.turn: r for r in tool_calls.link(calls, results, {"go": TOOL}).collect()}


def test_schemas(spark):
    got = linked(spark, [x if isinstance(x, str) else json.dumps(x) for x, _ in CASES])
    assert [sorted(got[i].errors) for i in range(len(CASES))] == [sorted(e) for _, e in CASES]


def test_numbers_have_one_form(spark):
    groups = [("1", "1.0", "1e0", "10e-1"), ("100", "1e2", "100.000"), ("-3", "-3.0"), ("2.5", "2.50", "25e-1"), ("123456789012", "1.23456789012e11")]
    texts = [f'{{"n":{x},"s":"1.0 and 1e2, \\"2.0\\"","deep":[{{"a":{x}}}]}}' for g in groups for x in g]
    got = linked(spark, texts)
    i = 0
    for g in groups:
        forms = {got[i + k].json for k in range(len(g))}
        forms = {f.split('"id"')[0] for f in forms}
        assert len(forms) == 1, forms
        assert f'"n":{g[0]},' in forms.pop() and '"s":"1.0 and 1e2, \\"2.0\\""' in got[i].json
        i += len(g)


def test_very_long_arguments(spark):
    text = "word " * 200_000
    got = linked(spark, [json.dumps({"n": 1, "unit": text})])
    assert got[0].errors == ["unit is none of its values"] and text in got[0].json
