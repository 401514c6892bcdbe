"""Results that come back after what they were asked for: kept if they are of the version asked for, counted apart else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(requests: DataFrame, results: DataFrame, wait: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """results with asked_version, asked_at and verdict: accepted if the request has the same version, stale if another one,
    late if there is no request for it in the time from wait before it up to it. Streams or tables.

    requests: key, request_id, version, asked_at; results: key, request_id, version, done_at, and more. On streams a late
    result comes out once both watermarks, late behind the newest rows, have passed; the state holds requests of the last
    wait and results that wait. A request of one key and id asked twice gives two rows for its result. Results with a null
    key, id or time are late.
    """
    asked = requests.withWatermark("asked_at", late).select(F.col("key").alias("__key"), F.col("request_id").alias("__id"), F.col("version").alias("asked_version"), "asked_at")
    done = results.withWatermark("done_at", late)
    on = F.expr(f"key = __key AND request_id = __id AND asked_at <= done_at AND asked_at >= done_at - INTERVAL {wait}")
    verdict = F.when(F.col("asked_at").isNull(), "late").when(F.col("version").eqNullSafe(F.col("asked_version")), "accepted").otherwise("stale")
    return done.join(asked, on, "left_outer").withColumn("verdict", verdict).drop("__key", "__id")


def verdict_counts(judged_rows: DataFrame, every: str = "1 hour") -> DataFrame:
    """(start, verdict, n): judged results in windows of their time."""
    counted = judged_rows.groupBy(F.window("done_at", every).alias("w"), "verdict").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "verdict", "n")
