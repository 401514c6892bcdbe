"""Stretches of rows of a key with no long gap between them, for keys that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefixes import stretches


def idle_periods(df: DataFrame, key: str, time_ms: str, gap_ms: int, parts: int = 16) -> DataFrame:
    """(key, start, idle_since, n): stretches of rows less than gap_ms apart, after each of which the key is idle.

    Rows with a null key or time are left out; rows at one time count each.
    """
    points = df.select(F.col(key).alias("k"), F.col(time_ms).cast("long").alias("lo"), F.lit(1).cast("long").alias("n")).where("k is not null and lo is not null")
    found = stretches(points.withColumn("hi", F.col("lo")), lambda lo, reach: lo - reach >= gap_ms, parts)
    return found.select(F.col("k").alias(key), F.col("lo").alias("start"), F.col("hi").alias("idle_since"), "n")
