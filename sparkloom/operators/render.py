"""Results as text and JSON: one row a line or an item, by built-in expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose lists of lines stand for a text.
LINE_KEYS = ("with", "body", "content")


def hit_lines(hits: DataFrame) -> DataFrame:
    """Search hits(path, line, text) as `path:line: text`."""
    return hits.withColumn("line_text", F.format_string("%s:%d: %s", F.col("path").cast("string"), "line", "text"))


def section_lines(sections: DataFrame) -> DataFrame:
    """Applied sections(path, op, new_tag, dest, first_changed_line) with the line that tells of each."""
    tag = F.substr("new_tag", F.lit(1), F.lit(7))
    told = (
        F.when(F.col("op") == "delete", F.format_string("deleted [%s]", "path"))
        .when((F.col("op") == "create") & F.col("new_tag").isNotNull(), F.concat(F.lit("created ["), "path", F.lit("#"), tag, F.lit("]")))
        .when((F.col("op") == "move") & F.col("dest").isNotNull() & F.col("new_tag").isNotNull(), F.concat(F.lit("moved ["), "path", F.lit("] -> ["), "dest", F.lit("#"), tag, F.lit("]")))
        .when(F.col("new_tag").isNotNull() & F.col("first_changed_line").isNotNull(), F.concat(F.lit("updated ["), "path", F.lit("#"), tag, F.lit("]  (first change at line "), F.col("first_changed_line").cast("string"), F.lit(")")))
        .when(F.col("new_tag").isNotNull(), F.concat(F.lit("updated ["), "path", F.lit("#"), tag, F.lit("]")))
        .otherwise(F.format_string("updated [%s]", "path"))
    )
    return sections.withColumn("told", told)


def section_json(sections: DataFrame) -> DataFrame:
    """Applied sections as JSON, shifts (after_line, delta) included."""
    return sections.withColumn("json", F.to_json(F.struct("path", "op", "new_tag", "dest", "first_changed_line", "shifts"), {"ignoreNullFields": "false"}))


def compact(shown: DataFrame, score: Column | None = None) -> DataFrame:
    """Shown symbols(file, start_line, kind, qualified, snippet) as `file:line kind qualified [~score]  — snippet`."""
    base = F.format_string("%s:%d %s %s", "file", "start_line", "kind", "qualified")
    near = "" if score is None else F.when(score.isNotNull(), F.concat(F.lit(" ~"), F.format_number(score, 2))).otherwise("")
    tail = F.when(F.trim("snippet") != "", F.concat(F.lit("  — "), F.trim("snippet"))).otherwise("")
    return shown.withColumn("line_text", F.concat(base, F.lit(near) if isinstance(near, str) else near, tail))


def failure(layer: str, **fields: object) -> str:
    """A failure as one JSON object, every field there, null where it is not known."""
    names = ("step", "operation", "path", "tag", "current", "expected", "replay", "rollback")
    if set(fields) - set(names):
        raise ValueError(f"unknown fields {sorted(set(fields) - set(names))}")
    return json.dumps({"kind": "failure", "layer": layer} | {n: fields.get(n) for n in names}, separators=(",", ":"))


def joined_lines(value: object) -> object:
    """A request in which lists of lines under LINE_KEYS, at any depth, are texts; content is ended by a line break."""
    if isinstance(value, Mapping):
        out = {}
        for key, child in value.items():
            if key in LINE_KEYS and isinstance(child, list) and all(isinstance(x, str) for x in child):
                out[key] = "\n".join(child) + ("\n" if key == "content" else "")
            else:
                out[key] = joined_lines(child)
        return out
    return [joined_lines(x) for x in value] if isinstance(value, list) else value


def program(make: Callable[..., object], variables: Mapping[str, str] | None = None) -> Sequence[dict]:
    """The steps that a user's program makes of its text variables: exactly one JSON value, an object with steps or a list of them."""
    made = json.loads(json.dumps(make(**(variables or {}))))
    steps = made.get("steps") if isinstance(made, dict) else made
    if not isinstance(steps, list) or not steps or not all(isinstance(s, dict) and isinstance(s.get("op"), str) for s in steps):
        raise ValueError("a program makes one value: a list of steps that each name an op")
    return [joined_lines(s) for s in steps]
