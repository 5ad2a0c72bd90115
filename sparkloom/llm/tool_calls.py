"""Chat formatting: links tool calls to their results, orders, validates and serialises them, in DataFrame operations.

Calls and results meet in a hash join on conversation and identifier; the earliest result of an identifier answers it.
Calls are ordered topologically: a call's level is one more than the highest level among the calls it depends on; chains
are followed by doubling, other calls by rounds; what a cycle holds back gets no level. Arguments are parsed as variants,
checked against their tool's schema, and written as canonical JSON: object keys sorted, no blanks, and one form for every
number: whole ones below 1e15 without point or exponent, whichever way they were written (1.0 and 1e2 are 1 and 100).
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


#: A JSON type, or a schema: type, and what of enum, items, properties, required and additionalProperties (a boolean) it states.
Schema = str | Mapping[str, object]


@dataclass(frozen=True)
class Tool:
    """The schema of a tool's arguments: property -> schema (types: string, integer, number, boolean, array, object), the
    required ones, and whether others may come too."""

    properties: Mapping[str, Schema]
    required: frozenset[str] = field(default_factory=frozenset)
    others: bool = True


#: The variant types that stand for a JSON type.
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}
#: The tokens of a JSON text: strings, numbers, and what is between them.
_TOKENS = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'
_WHOLE = 1e15


def _quoted(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def _wrong_type(value: Column, type_: str) -> Column:
    wrong = ~F.schema_of_variant(value).rlike(f"^(?:{_KINDS[type_]})$")
    if type_ == "integer":  # a number without a fraction is whole, as JSON Schema has it
        number = F.when(F.schema_of_variant(value).rlike("^(?:DOUBLE|DECIMAL.*)$"), F.try_variant_get(value, "$", "double"))
        wrong = wrong & ~F.coalesce(number == F.floor(number), F.lit(False))
    return wrong


def _faults(value: Column, schema: Schema, label: str) -> list[Column]:
    """Messages (null: none) on a value that is there, and on what it holds."""
    schema = {"type": schema} if isinstance(schema, str) else schema
    out: list[Column] = []
    type_ = schema.get("type")
    if type_ is not None:
        out.append(F.when(_wrong_type(value, type_), F.lit(f"{label} is no {type_}")))
    if "enum" in schema:
        listed = [json.dumps(x, separators=(",", ":"), ensure_ascii=False, sort_keys=True) for x in schema["enum"]]
        out.append(F.when(~_canonical(value).isin(listed), F.lit(f"{label} is none of its values")))
    if "items" in schema:
        wrong = lambda x: F.coalesce(*_faults(x, schema["items"], label), F.lit(None).cast("string")).isNotNull()
        out.append(F.when(F.exists(F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>")), wrong), F.lit(f"{label} has a wrong item")))
    required = frozenset(schema.get("required", ()))
    for prop, inner in sorted(schema.get("properties", {}).items()):
        child = F.try_variant_get(value, _quoted(prop), "variant")
        name = f"{label}.{prop}" if label else prop
        if prop in required:
            out.append(F.when(child.isNull(), F.lit(f"missing {name}")))
        out += [F.when(child.isNotNull(), fault) for fault in _faults(child, inner, name)]
    if schema.get("additionalProperties") is False:
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        out.append(F.when(F.exists(keys, lambda k: ~k.isin(sorted(schema.get("properties", {})) or [""])), F.lit(f"{label or 'arguments'} have further properties")))
    return out


def argument_errors(tools: Mapping[str, Tool], name: Column, arguments: Column) -> Column:
    """An array of messages on a variant of arguments; empty if they fit the tool's schema."""
    kind = F.schema_of_variant(arguments)
    cases: Column | None = None
    for tool, schema in sorted(tools.items()):
        checks = _faults(arguments, {"properties": schema.properties, "required": schema.required, "additionalProperties": schema.others}, "")
        found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        found = F.when(kind.startswith("OBJECT"), found).otherwise(F.array(F.lit("arguments are no object")))
        cases = F.when(name == tool, found) if cases is None else cases.when(name == tool, found)
    unknown = F.array(F.lit("unknown tool"))
    known = unknown if cases is None else cases.otherwise(unknown)
    return F.when(arguments.isNull(), F.array(F.lit("arguments are no JSON"))).otherwise(known)


def _canonical(value: Column) -> Column:
    """A variant as canonical JSON."""
    text = F.to_json(value)

    def token(t: Column) -> Column:
        number = t.cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < F.lit(_WHOLE))
        return F.when(t.rlike("^-?[0-9]") & t.rlike("[.eE]"), F.when(whole, number.cast("long").cast("string")).otherwise(t)).otherwise(t)

    odd = text.rlike(r"[0-9]\.[0-9]|[0-9][eE]")  # a fraction or an exponent, perhaps inside a text
    return F.when(odd, F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), token), "")).otherwise(text)


def _text(value: Column) -> Column:
    """A string as JSON; null as null."""
    wrapped = F.to_json(F.struct(value.alias("x")))  # {"x":...}
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))


def _chains(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(conv_id, call_id, root, dist): the first call on the way up from each call that does not depend on exactly one,
    and the steps to it; root is null on a cycle or behind one. The steps looked back double with every round."""
    key = ["conv_id", "call_id"]
    single = links.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("on").alias("root")).filter("n = 1").drop("n")
    rows = nodes.join(single, key, "left").withColumn("open", F.col("root").isNotNull()).withColumn("dist", F.col("open").cast("long")).withColumn("root", F.coalesce("root", "call_id"))
    rows = common.written(rows, "chains")
    left = rows.filter("open").count()
    while left:
        up = rows.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("up"), F.col("open").alias("on"), F.col("dist").alias("more"))
        # The calls next to a root reach it first; while any open call can, some do in every round.
        jumped = rows.filter("open").join(up, ["conv_id", "root"]).select(*key, F.col("up").alias("root"), F.col("on").alias("open"), (F.col("dist") + F.col("more")).alias("dist"))
        rows = common.written(rows.filter("not open").select(jumped.columns).unionByName(jumped), "chains")
        now = rows.filter("open").count()
        if now == left:
            break
        left = now
    return rows.select(*key, F.when(~F.col("open"), F.col("root")).alias("root"), "dist")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls(conv_id, call_id, depends_on array<string>).

    Dependencies on calls that the conversation does not have are ignored. Calls with one dependency take their level from
    the root of their chain; the others are freed in rounds, as many as it takes; every round's calls are written, and the
    rounds end when nothing new is free, so calls on a cycle or behind one get no level.
    """
    key = ["conv_id", "call_id"]
    nodes = calls.select(*key).distinct()
    links = calls.select(*key, F.explode("depends_on").alias("on")).distinct()
    links = common.written(links.join(nodes.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi"), "links")
    chains = _chains(nodes, links)
    done = common.written(nodes.join(links, key, "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    forks = links.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key)
    # From a call with several dependencies to the roots of their chains.
    spans = links.join(forks, key, "left_semi").join(chains.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left")
    spans = common.written(spans.groupBy(*key, "root").agg((F.max("dist") + 1).alias("steps")), "spans")
    newest, rounds = done, 0
    while True:
        # Only calls behind the newest ones can have become free.
        near = spans.join(newest.select("conv_id", F.col("call_id").alias("root")), ["conv_id", "root"], "left_semi").select(*key).distinct()
        ways = spans.join(near, key, "left_semi").join(done.select("conv_id", F.col("call_id").alias("root"), "level"), ["conv_id", "root"], "left")
        free = ways.groupBy(*key).agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("free"))
        newest = common.written(free.filter("free").drop("free"), "levels")
        if newest.isEmpty():
            break
        done, rounds = done.union(newest), rounds + 1
        if rounds % 32 == 0:
            done = common.written(done, "levels")  # one table again, so that plans stay small
    top = done.withColumnRenamed("call_id", "root")
    return chains.join(top, ["conv_id", "root"]).select(*key, (F.col("level") + F.col("dist")).cast("int").alias("level"))


def link(calls: DataFrame, results: DataFrame, tools: Mapping[str, Tool]) -> DataFrame:
    """A row a call: conv_id, turn, call_id, name, level, linked, n_results, errors, valid and json.

    calls: conv_id, turn, call_id, name, arguments (JSON text), depends_on array<string>; results: conv_id, turn, call_id,
    content. Rows whose conv_id or call_id is null take no part. If calls repeat an identifier, the one of the smallest
    (turn, name, arguments) counts; a call without result has linked false; results without call are in orphans().
    Further columns, of any name, play no part; texts of any length are taken whole; empty tables give empty tables.
    """
    key = ["conv_id", "call_id"]
    some = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = calls.filter(some).groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c")).select(*key, "c.*")
    first = first.withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))
    answer = results.filter(some).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    # One row a call on either side, so no key is hot; the results are the side that is hashed.
    rows = first.join(answer.hint("shuffle_hash"), key, "left").join(levels(first), key, "left")
    v = F.try_parse_json("arguments")
    rows = rows.withColumn("v", v).withColumn("errors", argument_errors(tools, F.col("name"), F.col("v")))
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce(_canonical(F.col("v")), F.lit("null")), F.lit(',"id":'), _text(F.col("call_id")),
        F.lit(',"name":'), _text(F.col("name")), F.lit(',"result":'), _text(F.col("r.content")), F.lit("}"),
    )
    return rows.select(
        "conv_id", "turn", "call_id", "name", "level", F.col("n_results").isNotNull().alias("linked"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "errors", (F.size("errors") == 0).alias("valid"), line.alias("json")
    )


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results whose identifier no call of their conversation has."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")


#: The tool that turns of a conversation are read as calls of.
REPLY = {"reply": Tool({"role": "string", "text": "string", "turn": "integer"}, frozenset({"role", "text", "turn"}))}


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table (conv_id, turn, role, text) without tool calls of its own.

    Every user turn is a call of `reply`, named by its turn, that depends on the user turn two turns before it, if there is
    one, so that a conversation is a chain of calls; an assistant turn is the result named by the turn before it.
    """
    rows = messages.filter("conv_id is not null and turn is not null")
    calls = rows.filter("role = 'user'").select(
        "conv_id", "turn", F.col("turn").cast("string").alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text"), F.col("turn"), F.col("role"))).alias("arguments"), F.array((F.col("turn") - 2).cast("string")).alias("depends_on"),
    )
    results = rows.filter("role = 'assistant'").select("conv_id", "turn", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("text").alias("content"))
    return calls, results


def tool_call_digest(messages: DataFrame) -> DataFrame:
    """A row for every call of messages(conv_id, turn, role, text), with the SHA-256 of its canonical JSON.

    Rows whose conv_id or turn is null take no part; a null text is an argument that is missing, and the call is not
    valid; repeated turns count once. Long texts, other columns and empty tables are as in link().
    """
    calls, results = turns_as_calls(messages)
    rows = link(calls, results, REPLY)
    return rows.select("conv_id", "turn", "call_id", F.col("level").cast("int").alias("level"), "linked", "valid", F.sha2("json", 256).alias("json_sha256"))
