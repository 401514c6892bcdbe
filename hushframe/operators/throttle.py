"""Throttling: a row is taken if no row taken before it is nearer than an interval. Each depends on the last one taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .asof import following


def throttled(df: DataFrame, key: str, time: str, order: str, interval: int, parts: int = 16) -> DataFrame:
    """The rows of df that are taken: the first of each key, then each first one at least interval after the last one taken.

    time and order are whole numbers, (key, order) tells rows apart; rows at one time go by order. The row that would be
    taken next is found for every row by one as-of join; then the rows taken are followed from the first ones by pointers
    that double their reach in each round, so that n rows taken of a key need about log2 n rounds, each over narrow tables
    dealt by row, not by key. Rows with a null key, time or order are left out; no rows give none.
    """
    if interval <= 0:
        raise ValueError("the interval must be positive")
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(order).isNotNull())
    places = cut(rows.select(F.col(key).alias("k"), F.col(time).cast("long").alias("t"), F.col(order).cast("long").alias("o")), "throttle-rows")
    ahead = following(places.withColumn("due", F.col("t") + interval).select("k", "o", F.col("due").alias("t")), places, "k", "t", "o", parts)
    jump = cut(ahead.select("k", "o", F.col("found.order").alias("to")).where("to is not null"), "throttle-jumps")
    taken = cut(places.groupBy("k").agg(F.min_by("o", F.struct("t", "o")).alias("o")), "throttle-taken")
    count = taken.count()
    while True:
        reached = taken.join(jump, ["k", "o"]).select("k", F.col("to").alias("o"))
        taken = cut(taken.unionByName(reached).distinct(), "throttle-taken")
        before, count = count, taken.count()
        if count == before:
            break
        onward = jump.select("k", F.col("o").alias("to"), F.col("to").alias("beyond"))
        jump = cut(jump.join(onward, ["k", "to"]).select("k", "o", F.col("beyond").alias("to")), "throttle-jumps")
    chosen = taken.select(F.col("k").alias("__k"), F.col("o").alias("__o"))
    return df.join(chosen, (F.col(key) == F.col("__k")) & (F.col(order) == F.col("__o")), "left_semi")
