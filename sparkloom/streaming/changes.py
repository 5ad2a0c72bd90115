"""Streaming forms: debounced change batches, incremental refresh, the hint machine, subscriptions, expiry and traces.

Event time and watermarks are what Spark needs to close windows; batch forms are in operators.sessions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..operators.sessions import SOLO_READS
from ..sources import shared


def debounced(events: DataFrame, by: str, ts: str = "ts", gap: str = "300 milliseconds", late: str = "10 seconds", what: str | None = None) -> DataFrame:
    """Batches of changes that pauses over `gap` part: (by, start, end, n[, the sorted distinct values of `what`])."""
    out = [F.count(F.lit(1)).alias("n")] + ([F.array_sort(F.collect_set(what)).alias(what)] if what else [])
    rows = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.max(ts).alias("end"), *out)
    return rows.select(by, F.col("w.start").alias("start"), "end", "n", *([what] if what else []))


def hints(events: DataFrame, by: str, solo: str) -> DataFrame:
    """(by, hint_at): the position of the read that completes the first SOLO_READS solo reads in a row, once a key.

    events(by, seq, solo boolean); within a micro-batch rows are taken in the order of seq. State: reads seen, solo reads
    in a row, whether the hint was given.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, row, given = state.get if state.exists else (0, 0, False)
        at = None
        batch = pd.concat(list(parts)).sort_values("seq", kind="stable")
        for is_solo in batch[solo]:
            seen += 1
            row = row + 1 if is_solo else 0
            if not given and row == SOLO_READS:
                given, at = True, seen
        state.update((seen, row, given))
        if at is not None:
            yield pd.DataFrame({by: [key[0]], "hint_at": [at]})

    kind = events.schema[by].dataType.simpleString()
    return events.select(by, "seq", solo).groupBy(by).applyInPandasWithState(step, f"{by} {kind}, hint_at int", "seen int, streak int, given boolean", "append", GroupStateTimeout.NoTimeout)


def subscribed(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A row for each subscription(session, kinds, workspaces) that an event(kind, workspace) reaches: a stream-static join on kind."""
    by_kind = subscriptions.select("session", "workspaces", F.explode("kinds").alias("kind"))
    open_ = F.coalesce(F.size("workspaces") <= 0, F.lit(True)) | F.col("workspace").isNull() | F.array_contains("workspaces", F.col("workspace"))
    return events.join(by_kind, "kind").filter(open_).drop("workspaces")


def expiring(touches: DataFrame, by: str, ts: str = "ts", ttl_ms: int = 3 * 24 * 3600 * 1000, late: str = "1 hour") -> DataFrame:
    """(by, touched): keys that nothing has touched for the time to live, when the watermark has passed it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({by: [key[0]], "touched": [pd.Timestamp(last, unit="ms")]})
            return
        (last,) = state.get if state.exists else (0,)
        for part in parts:
            last = max(last, part[ts].max().value // 1_000_000)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))

    kind = touches.schema[by].dataType.simpleString()
    rows = touches.withWatermark(ts, late).select(by, ts).groupBy(by)
    return rows.applyInPandasWithState(step, f"{by} {kind}, touched timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def refreshed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """files(path, text, tag) after changed(path, text or null, seq): the last change of a path wins, a null text deletes it,
    an equal tag changes nothing."""
    last = changed.groupBy("path").agg(F.max(F.struct("seq", "text")).alias("x")).select("path", "x.text")
    new = last.filter("text is not null").select("path", X.normalize_lf(F.col("text")).alias("text")).withColumn("tag", X.tag(F.col("text")))
    same = files.join(new.select("path", "tag"), ["path", "tag"], "left_semi")
    others = files.join(last.select("path"), "path", "left_anti")
    return others.unionByName(same.select(files.columns)).unionByName(new.join(same.select("path"), "path", "left_anti").select(files.columns))


def follow(changes: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch of changes, one row a path, to update(batch, id)."""

    def each(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max(F.struct("seq", "text")).alias("x")).select("path", "x.seq", "x.text")
        update(last, number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trace(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends events as JSON lines."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("compression", "gzip").trigger(availableNow=True).start()


def drained(rows: DataFrame, name: str) -> DataFrame:
    """A stream run over all that its source has now, in append mode, as a written table."""
    spark = rows.sparkSession
    path = shared.scratch(spark, name)
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def streamed(table: DataFrame) -> DataFrame:
    """A written table as the source of a stream."""
    return table.sparkSession.readStream.schema(table.schema).parquet(table._shared_path)
