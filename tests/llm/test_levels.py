"""Levels of tool calls in deep and mixed graphs against a plain topological order."""

import random

from sparkloom.llm import tool_calls


def plain(rows):
    """(conv, call) -> level by Kahn's rounds; calls on cycles or behind them are left out."""
    needs = {(c, i): {(c, d) for d in on if any(r[:2] == (c, d) for r in rows)} for c, i, on in rows}
    out = {}
    while True:
        free = {k: 1 + max((out[d] for d in on), default=-1) for k, on in needs.items() if k not in out and all(d in out for d in on)}
        if not free:
            return out
        out |= free


def found(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>").repartition(3)
    got = tool_calls.levels(df).collect()
    assert len({(r.conv_id, r.call_id) for r in got}) == len(got)
    return {(r.conv_id, r.call_id): r.level for r in got}


def test_chain_deeper_than_a_thousand(spark):
    rows = [(1, str(i), [str(i - 1)] if i else []) for i in range(1500)] + [(1, "join", ["1499", "700"]), (1, "after", ["join"])]
    got = found(spark, rows)
    assert len(got) == len(rows) and all(got[1, str(i)] == i for i in range(1500)) and got[1, "join"] == 1500 and got[1, "after"] == 1501


def test_random_graphs_with_cycles(spark):
    rng = random.Random(7)
    rows = []
    for conv in range(60):
        n = rng.randint(1, 14)
        for i in range(n):
            on = [str(rng.randrange(i)) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))] if i else []
            rows.append((conv, str(i), on + (["gone"] if rng.random() < 0.1 else [])))
        rows += [(conv, "a", ["b"]), (conv, "b", ["c"]), (conv, "c", ["a"]), (conv, "self", ["self"]), (conv, "d", ["a"]), (conv, "e", ["0", "d"]), (conv, "f", ["e"])] if conv % 3 == 0 else []
    assert found(spark, rows) == plain(rows)
