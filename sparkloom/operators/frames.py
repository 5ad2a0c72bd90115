"""Frames: commands that come in as JSON lines, events and results that go out as JSON lines, and what sessions may ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import policy

#: Bytes of a frame, sessions at a time, milliseconds to wait after a refusal, events held for a session.
MAX_FRAME = 8 * 1024 * 1024
MAX_SESSIONS = 4096
BACKOFF_MS = 50
BUFFER = 256


def inbound(lines: DataFrame, line: str = "line", cap: int = MAX_FRAME) -> DataFrame:
    """lines with ch (the frame's kind), id, op and error: frames over the cap, invalid UTF-8 (of a binary column), malformed
    JSON and frames without a kind are errors, and have no other column."""
    raw = F.col(line)
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    v = F.try_parse_json(text)
    get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    error = (
        F.when(F.octet_length(raw) > cap, F.format_string("frame exceeds the %d byte limit", F.lit(cap)))
        .when(raw.isNotNull() & text.isNull(), "frame is not valid UTF-8").when(v.isNull() | get("ch").isNull(), "malformed frame")
    )
    out = lines.withColumn("error", error)
    for name, column in (("ch", "ch"), ("id", "id"), ("op", "op")):
        out = out.withColumn(column, F.when(F.col("error").isNull(), get(name)))
    return out


def numbered(frames: DataFrame, order: list[Column]) -> DataFrame:
    """frames with seq: one sequence from 1 over all sessions, as the registry counts them.

    One order over all rows needs their numbers before each part of it: rows are split into ranges by the order's first
    column, counted, and numbered within their range from its base, so no task holds more than a range.
    """
    spark = frames.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = frames.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    from ..sources import shared

    cut = shared.written(cut, "frames")
    counts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row a range
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return cut.withColumn("_local", local).join(F.broadcast(base), "_part").withColumn("seq", F.col("base") + F.col("_local")).drop("_part", "_local", "base")


def outbound(events: DataFrame) -> DataFrame:
    """Events(seq, kind, workspace, payload as JSON text) as frames: events with line, the JSON text of each."""
    body = F.concat(
        F.lit('{"ch":"event","seq":'), F.col("seq").cast("string"), F.lit(',"kind":'), _text(F.col("kind")),
        F.when(F.col("workspace").isNotNull(), F.concat(F.lit(',"workspace":'), _text(F.col("workspace")))).otherwise(""), F.lit(',"payload":'), F.coalesce("payload", F.lit("null")), F.lit("}"),
    )
    return events.withColumn("line", body)


def refusal(id_: Column, seq: Column, limit: int) -> Column:
    """The frame that answers a command over the limit of commands in flight."""
    message = f"session has {limit} commands in flight; retry when one finishes"
    return F.to_json(F.struct(F.lit("error").alias("ch"), id_.alias("id"), seq.alias("seq"), F.lit(message).alias("message"), F.lit(True).alias("retry"), F.lit(BACKOFF_MS).alias("backoff_ms")))


def _text(value: Column) -> Column:
    wrapped = F.to_json(F.struct(value.alias("x")))
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def observed(commands: DataFrame, steps: DataFrame) -> DataFrame:
    """commands(command, op, validates) with admitted, for sessions that only observe: the op must be one of the readonly
    profile and nothing may be validated; of a multi-op, which needs a step, that holds of every one of steps(command, op, validates)."""
    allowed = sorted(set(policy.READ_OPS))
    fine = F.col("op").isin(allowed) & ~F.coalesce("validates", F.lit(False))
    per = steps.groupBy("command").agg(F.bool_and(fine).alias("_steps"))
    rows = commands.join(per, "command", "left")
    many = F.coalesce("_steps", F.lit(False)) & ~F.coalesce("validates", F.lit(False))
    return rows.withColumn("admitted", F.when(F.col("op") == "multi-op", many).otherwise(fine)).drop("_steps")


def overflowed(events: DataFrame, by: str, order: list[Column], taken: str, buffer: int = BUFFER) -> DataFrame:
    """(by, delivered, dropped) of events that wait for a session which has taken `taken` of them: what does not fit its buffer is dropped."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = events.withColumn("_k", F.row_number().over(w))
    fits = F.col("_k") <= F.col(taken) + buffer
    return rows.groupBy(by).agg(F.count_if(fits).alias("delivered"), F.count_if(~fits).alias("dropped"))


def sessions(events: DataFrame, order: list[Column], token: str = "token") -> DataFrame:
    """events(session, kind, token) of open, resume and close with ok: a session that exists resumes with the token it was
    opened with; one that was closed, or never opened, does not. Opening again gives a new token."""
    w = Window.partitionBy("session").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("kind").isin("open", "close"), F.struct("kind", F.col(token).alias("token"))), ignorenulls=True).over(w)
    rows = events.withColumn("_last", opened)
    there = F.coalesce(F.col("_last.kind") == "open", F.lit(False))
    ok = F.when(F.col("kind") == "open", F.lit(True)).when(F.col("kind") == "resume", there & (F.col(token) == F.col("_last.token"))).otherwise(there)
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_last")
