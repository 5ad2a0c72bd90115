"""Edit requests, JSON texts, compiled to sections and hunks as rows; what is wrong with a request is a row too.

A request is one object or an array of them, one a section: {"path", "tag", "edits": [...]}, where an edit is one of

    {"replace": anchor, "with": text}    {"delete": anchor}    {"insert": {"before" | "after": line | "^" | "$"}, "body": text}
    {"move": {"to": path}}               {"remove": true}      anchor: {"symbol": name} | {"lines": [a, b]} | {"block": line}

Requests are parsed to variants once, exploded to sections and steps, and anchors are found by joins with the symbols and
blocks of the files they name. A request with a fault compiles to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from . import edits

SECTION = ("req", "section", "path", "tag", "file_op", "dest")
HUNK = ("req", "section", "path", "seq", "action", "start", "end", "body")
_HUNK_TYPES = "req long, section int, path string, seq int, action string, start int, end int, body array<string>"


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column) -> Column:
    """The first word of a variant's type: STRING, BIGINT, ARRAY, OBJECT, VOID (JSON's null) and so on; null for nothing."""
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def _text(v: Column, path: str) -> Column:
    at = _get(v, path)
    return F.when(_kind(at) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str) -> Column:
    """A whole number from 1."""
    n = F.when(_kind(_get(v, path)) == "BIGINT", F.try_variant_get(v, path, "int"))
    return F.when(n >= 1, n)


def _items(v: Column, path: str) -> Column:
    return F.when(_kind(_get(v, path)) == "ARRAY", F.try_variant_get(v, path, "array<variant>"))


def _steps(sections: DataFrame) -> DataFrame:
    """A row for each edit of a section: what it does, where, and the fault that its own form shows."""
    e = F.col("e")
    rows = sections.select("req", "section", "path", "tag", F.posexplode("edits").alias("seq", "e"))
    has = lambda key: _get(e, f"$.{key}").isNotNull()
    remove = F.coalesce(F.when(_kind(_get(e, "$.remove")) == "BOOLEAN", F.try_variant_get(e, "$.remove", "boolean")), F.lit(False))
    what = F.when(has("replace"), "replace").when(has("insert"), "insert").when(has("delete"), "delete").when(has("move"), "move").when(remove, "remove")
    rows = rows.withColumn("what", what)
    key = F.when(F.col("what") == "replace", F.lit("replace")).when(F.col("what") == "delete", F.lit("delete"))

    def of(get, inner: str) -> Column:
        """A part of the anchor of a replacement or of a deletion."""
        return F.when(key == "replace", get(e, f"$.replace.{inner}")).when(key == "delete", get(e, f"$.delete.{inner}"))

    pair = of(lambda v, p: F.when(_kind(_get(v, p)) == "ARRAY", F.lit(True)), "lines")
    a, b = of(_number, "lines[0]"), of(_number, "lines[1]")
    rows = rows.select(
        "req", "section", "path", "tag", "seq", "what", of(_text, "symbol").alias("symbol"), pair.alias("pair"), a.alias("a"), b.alias("b"),
        of(lambda v, p: F.when(_kind(_get(v, p)) == "BIGINT", F.lit(True)), "block").alias("is_block"), of(_number, "block").alias("block"),
        F.when(F.col("what") == "replace", _text(e, "$.with")).when(F.col("what") == "insert", _text(e, "$.body")).alias("given"),
        _get(e, "$.insert.before").isNotNull().alias("is_before"), _get(e, "$.insert.after").isNotNull().alias("is_after"),
        _text(e, "$.insert.before").alias("before_text"), _number(e, "$.insert.before").alias("before"), _text(e, "$.insert.after").alias("after_text"), _number(e, "$.insert.after").alias("after"),
        _text(e, "$.move.to").alias("dest"),
    )
    anchored = F.col("what").isin("replace", "delete")
    fault = (
        F.when(F.col("what").isNull(), "unknown action")
        .when(F.col("what").isin("replace", "insert") & F.col("given").isNull(), "no text")
        .when(anchored & F.col("symbol").isNotNull(), F.when(F.col("tag") == "new", "symbol in a new file"))
        .when(anchored & F.col("pair"), F.when(F.col("a").isNull() | F.col("b").isNull() | (F.col("b") < F.col("a")), "bad lines"))
        .when(anchored & F.col("is_block"), F.when(F.col("block").isNull(), "bad block"))
        .when(anchored, "no anchor")
        .when((F.col("what") == "insert") & F.col("is_before"), F.when(F.col("before").isNull() & ~F.coalesce(F.col("before_text") == "^", F.lit(False)), "bad place"))
        .when((F.col("what") == "insert") & F.col("is_after"), F.when(F.col("after").isNull() & ~F.coalesce(F.col("after_text") == "$", F.lit(False)), "bad place"))
        .when(F.col("what") == "insert", "bad place")
        .when((F.col("what") == "move") & F.col("dest").isNull(), "no destination")
    )
    return rows.withColumn("fault", fault)


def compiled(requests: DataFrame, symbols: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """requests(req, body) as sections(SECTION), hunks(HUNK) and faults(req, section, seq, fault), sections and seq from 0.

    symbols(file, name, qualified, kind, start_line) and spans(file, start, end) are those of the files named. file_op is
    move, with dest, remove or null. A fault of a section as a whole has seq -1, one of the request section -1. Anchors by
    name need one line of the file that begins a symbol so named; blocks that begin on a line give the widest one.
    """
    # Requests are small and costly to parse: as they come, a few tasks would have them all, and those of the tables written of them.
    whole = shared.dealt(requests.select("req", "body"), "req").select("req", F.try_parse_json("body").alias("v"))
    ops = F.when(_kind(F.col("v")) == "ARRAY", F.try_variant_get("v", "$", "array<variant>")).when(_kind(F.col("v")) == "OBJECT", F.array("v"))
    rows = shared.written(whole.select("req", ops.alias("ops")).select("req", F.transform("ops", lambda x: F.to_json(x)).alias("ops")), "requests")
    bad = rows.filter("ops is null or size(ops) = 0").select("req", F.lit(-1).alias("section"), F.lit(-1).alias("seq"), F.lit("no sections").alias("fault"))
    op = rows.select("req", F.posexplode("ops").alias("section", "text")).select("req", "section", F.parse_json("text").alias("op"))
    name = _get(F.col("op"), "$.op")
    wrong = name.isNotNull() & (_kind(name) == "STRING") & (F.try_variant_get("op", "$.op", "string") != "mutate.edit")
    sections = op.select("req", "section", _text(F.col("op"), "$.path").alias("path"), _text(F.col("op"), "$.tag").alias("tag"), _items(F.col("op"), "$.edits").alias("edits"), wrong.alias("wrong"))
    missing = F.when(F.col("wrong"), "another op").when(F.col("path").isNull(), "no path").when(F.col("tag").isNull(), "no tag").when(F.coalesce(F.size("edits") < 1, F.lit(True)), "no edits")
    sections = sections.withColumn("fault", missing)
    steps = shared.written(_steps(sections.filter("fault is null")), "steps")

    asked = steps.filter("fault is null")
    names = edits.anchored(symbols, asked.filter("symbol is not null").select(F.col("path").alias("file"), F.col("symbol").alias("anchor")).distinct())
    found = asked.join(names.select(F.col("file").alias("path"), F.col("anchor").alias("symbol"), F.col("n").alias("names"), F.col("line").alias("named")), ["path", "symbol"], "left")
    found = found.withColumn("head", F.coalesce("named", "block"))
    blocks = edits.blocks_at(spans, found.filter("head is not null").select(F.col("path").alias("file"), F.col("head").alias("line")).distinct())
    found = shared.written(found.join(blocks.select(F.col("file").alias("path"), F.col("line").alias("head"), "state", F.col("end").alias("until")), ["path", "head"], "left"), "found")
    unresolved = F.when(F.col("names") == 0, "unknown symbol").when(F.col("names") > 1, "ambiguous symbol").when(F.col("state") == "missing", "no block")

    ops_of = steps.filter("what in ('move', 'remove')").groupBy("req", "section").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.max(F.col("what") == "remove").alias("removes"))
    edits_of = steps.filter("what in ('replace', 'insert', 'delete')").select("req", "section").distinct().withColumn("edits", F.lit(True))
    clash = ops_of.join(edits_of, ["req", "section"], "left").select("req", "section", F.when(F.col("n") > 1, F.col("last")).otherwise(F.lit(-1)).alias("seq"), F.when(F.col("n") > 1, "two moves or removals").when(F.col("removes") & F.col("edits"), "removal with edits").alias("fault"))
    parts = [bad, sections.select("req", "section", F.lit(-1).alias("seq"), "fault"), steps.select("req", "section", "seq", "fault"), found.select("req", "section", "seq", unresolved.alias("fault")), clash]
    faults = parts[0]
    for p in parts[1:]:
        faults = faults.unionByName(p)
    faults = shared.written(faults.filter("fault is not null"), "faults")

    fine = lambda df: df.join(faults.select("req").distinct(), "req", "left_anti")
    moves = steps.filter("what in ('move', 'remove')").select("req", "section", F.col("what").alias("file_op"), "dest")
    out = fine(sections.select("req", "section", "path", "tag")).join(moves, ["req", "section"], "left").select(*SECTION)
    body = F.when(F.col("given") == "", F.array().cast("array<string>")).otherwise(F.split("given", "\n", -1))
    action = (
        F.when(F.col("what") == "replace", "replace").when(F.col("what") == "delete", "cut")
        .when(F.col("before").isNotNull(), "insert_before").when(F.col("is_before"), "bof").when(F.col("after").isNotNull(), "insert_after").otherwise("eof")
    )
    start = F.coalesce("a", "head", F.when(F.col("is_before"), F.coalesce("before", F.lit(0))), F.col("after"), F.lit(0))
    end = F.coalesce("b", "until", "head", F.when(F.col("is_before"), F.coalesce("before", F.lit(0))), F.col("after"), F.lit(0))
    hunks = fine(found.filter("what in ('replace', 'insert', 'delete')")).select("req", "section", "path", "seq", action.alias("action"), start.alias("start"), end.alias("end"), F.when(F.col("what") != "delete", body).otherwise(F.array().cast("array<string>")).alias("body"))
    return out, hunks, faults
