"""Windowed counts and unchanged-snapshot sinks over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("event_type",), every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, keys, n): events of each tumbling window; the watermark only bounds the state."""
    marked = events.withWatermark(time, late)
    return marked.groupBy(F.window(time, every).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of events with no longer gap between them."""
    marked = events.withWatermark(time, late)
    return marked.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def only_changes(keys: list[str], write: Callable[[DataFrame, int], None], last: dict | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a batch of snapshots only where it differs from the one written before.

    The digest of a batch is what is remembered, not its rows.
    """
    remembered = {} if last is None else last

    def each(batch: DataFrame, batch_id: int) -> None:
        digest = batch.select(F.xxhash64(*sorted(batch.columns)).cast("decimal(20,0)").alias("h")).agg(F.sum("h").alias("s"), F.count("*").alias("n")).first()
        if remembered.get("digest") != (digest["s"], digest["n"]):
            write(batch, batch_id)
            remembered["digest"] = (digest["s"], digest["n"])

    return each
