"""Rebuilds of an index once its sources have stayed the same for a while, as a stream with timers.

Samples of a fingerprint come by key in any order within the watermark's delay. Each key keeps a list of the samples that the
watermark has not passed yet, and a timer for the first of them; when a timer fires, the samples up to there are taken in
order of time: a new fingerprint begins a run, and the first sample that is as old as the wait in a run of a fingerprint other
than the indexed one is a rebuild. So batches, partitions and the order of arrival make no difference.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SAMPLE = "at long, fingerprint string"
_RUN = "built string, fingerprint string, since long, done boolean"


class _Stable(StatefulProcessor):
    def __init__(self, by: str, wait: int) -> None:
        self.by, self.wait = by, wait  # in microseconds, as all places in time here

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _SAMPLE)
        self.run = handle.getValueState("run", _RUN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for part in rows:
            self.waiting.appendList([(int(at), f) for at, f in zip(part["at"], part["fingerprint"], strict=True)])
        first = min((at for at, _ in self.waiting.get()), default=None)
        if first is not None:
            self.handle.registerTimer(max(-(-first // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((int(at), f) for at, f in self.waiting.get())
        ready, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        built, now, since, done = self.run.get() if self.run.exists() else (None, None, None, False)
        out = []
        for i, (at, f) in enumerate(ready):
            if since is None:
                built = f  # what is indexed at the start
            if since is None or f != now:
                now, since, done = f, at, False
            if not done and at - since >= self.wait:
                done = True
                if f != built:
                    built = f
                    out.append((key[0], at, f))
        if since is not None:
            self.run.update((built, now, since, done))
        self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(-(-later[0][0] // 1000))
        return iter([pd.DataFrame(out, columns=[self.by, "at", "fingerprint"])] if out else [])

    def close(self) -> None:
        pass


def rebuilds(samples: DataFrame, by: str, ts: str, fingerprint: str, seconds: int = 10, late: str = "1 minute") -> DataFrame:
    """(by, ts, fingerprint): the samples at which an index is built anew, as catalog.stable_rebuilds() gives them for a table.
    Sets the session's state store to RocksDB, which Spark asks for where state has timers.

    samples(by, ts, fingerprint) is a stream; samples that come later than `late` behind the latest are dropped, and one comes
    out when the watermark has passed it.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    rows = samples.withWatermark(ts, late).select(by, ts, F.unix_micros(F.col(ts)).alias("at"), F.col(fingerprint).alias("fingerprint"))
    schema = T.StructType([samples.schema[by], T.StructField("at", T.LongType()), T.StructField("fingerprint", T.StringType())])
    made = rows.groupBy(by).transformWithStateInPandas(_Stable(by, seconds * 1_000_000), schema, "Append", "EventTime")
    return made.select(by, F.timestamp_micros("at").alias(ts), F.col("fingerprint").alias(fingerprint))
