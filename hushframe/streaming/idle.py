"""Idle timers: a stream of rows becomes a stream of the stretches after which their key fell silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class _Idle(StatefulProcessor):
    """Keeps the open stretches (start, end, n) of a key, in ms; a timer at the end of each closes it and clears the state."""

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, end long, n long")

    def _keep(self, stretches: list[tuple[int, int, int]]) -> None:
        if stretches:
            self.open.put(stretches)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        had = [tuple(map(int, s)) for s in self.open.get()] if self.open.exists() else []
        merged: list[tuple[int, int, int]] = []
        for start, end, n in sorted(had + [(int(t), int(t), 1) for batch in rows for t in batch["ms"]]):
            if merged and start - merged[-1][1] < self.gap_ms:
                first, last, count = merged[-1]
                merged[-1] = (first, max(last, end), count + n)
            else:
                merged.append((start, end, n))
        before, after = {s[1] for s in had}, {s[1] for s in merged}
        for end in before - after:
            self.handle.deleteTimer(end + self.gap_ms)
        for end in after - before:
            self.handle.registerTimer(end + self.gap_ms)
        self._keep(merged)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(map(int, s)) for s in self.open.get()]
        closed = [s for s in held if s[1] + self.gap_ms <= due]
        self._keep([s for s in held if s[1] + self.gap_ms > due])
        if closed:
            yield pd.DataFrame({"key": [key[0]] * len(closed), "start": [s[0] for s in closed], "idle_since": [s[1] for s in closed], "n": [s[2] for s in closed]})

    def close(self) -> None:
        pass


def idle_since(events: DataFrame, key: str, time: str, gap_ms: int, late: str = "1 hour") -> DataFrame:
    """A stream (key, start, idle_since, n), in ms, of events that have a timestamp time: a row once the watermark, late behind
    the newest event, has passed gap_ms after the last event of a stretch. After all input it is what sessions.idle_periods
    finds, but for events later than the watermark, which Spark leaves out, and stretches that the watermark has not closed.

    The state of a key is its open stretches, few as they lie between the watermark and the newest event; it is gone when the
    last one closes. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Rows with a null
    key or time are left out.
    """
    rows = events.where(F.col(time).isNotNull() & F.col(key).isNotNull()).withWatermark(time, late).select(F.col(key).alias("key"), F.col(time).alias("at"), F.unix_millis(F.col(time)).alias("ms"))
    kind = dict(rows.dtypes)["key"]
    found = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Idle(gap_ms), outputStructType=f"key {kind}, start long, idle_since long, n long", outputMode="Append", timeMode="EventTime")
    return found.withColumnRenamed("key", key)
