"""Running sums, maxima and last values over the rows of a key in order, for keys that no single task could hold.

Rows are dealt to parts by where their order lies among fixed bounds; each part of a key runs by itself, and what the parts
before it come to, one small row for each key and part, is carried in by a join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

PART = "__part"


def with_part(df: DataFrame, order: str, parts: int = 16) -> DataFrame:
    """df with PART: how many of parts - 1 bounds, which deal all rows about equally, lie at or below a number or time; 0 for null."""
    timed = dict(df.dtypes)[order] in ("date", "timestamp", "timestamp_ntz")
    place = F.unix_micros(F.col(order).cast("timestamp")) if timed else F.col(order)
    bounds = sorted(set(df.select(place.cast("double").alias("p")).approxQuantile("p", [i / parts for i in range(1, parts)], 0.01)))
    at = reduce(lambda n, b: n + F.coalesce((place.cast("double") >= b).cast("int"), F.lit(0)), bounds, F.lit(0))
    return df.withColumn(PART, at)


def _joined(rows: DataFrame, carried: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with what is carried into their key and part; null keys are a key like any other."""
    renamed = carried.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, PART])], F.col(name).alias("__carried"))
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"__k{i}"]) for i, k in enumerate([*keys, PART])])
    return rows.join(renamed, on, "left").drop(*[f"__k{i}" for i in range(len(keys) + 1)])


def _running(df: DataFrame, keys: list[str], order: list[Column], name: str, own: Callable, total: Column, over: Callable, both: Callable, inclusive: bool) -> DataFrame:
    inside = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, PART).agg(total.alias("__total"))
    carried = totals.withColumn("__carry", over(F.col("__total")).over(before)).where("__carry is not null")
    rows = _joined(df.withColumn(name, own().over(inside)), carried, keys, "__carry")
    return rows.withColumn(name, both(F.col("__carried"), F.col(name))).drop("__carried")


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df (with PART) with the sum of value up to and with each row."""
    plus = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return _running(df, keys, order, name, lambda: F.sum(value), F.sum(value), F.sum, plus, True)


def running_max(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df (with PART) with the greatest value of the rows before each row."""
    return _running(df, keys, order, name, lambda: F.max(value), F.max(value), F.max, F.greatest, False)


def last_value(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, at: Column) -> DataFrame:
    """df (with PART) with the last value that is not null up to and with each row; at: the order as one column that can be compared."""
    last = lambda c: F.last(c, ignorenulls=True)
    total = F.max_by(value, F.when(value.isNotNull(), at))
    return _running(df, keys, order, name, lambda: last(value), total, last, lambda a, b: F.coalesce(b, a), True)


def stretches(df: DataFrame, fresh: Callable[[Column, Column], Column], parts: int = 16) -> DataFrame:
    """(k, lo, hi, n) of intervals (k, lo, hi, n): those that hang together made one, their n added up. fresh(lo, reach):
    whether an interval that begins at lo begins a stretch where those before it reach to reach.

    Stretches are made in each part of a key first; those at the parts' ends are then joined by what the parts before come to.
    """
    rows = with_part(df, "lo", parts)
    inside = Window.partitionBy("k", PART).orderBy("lo", "hi")
    reach = F.max("hi").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("fresh", (reach.isNull() | fresh(F.col("lo"), reach)).cast("int"))
    numbered = marked.withColumn("island", F.sum("fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = cut(numbered.groupBy("k", PART, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")), "stretches")
    behind = running_max(local, ["k"], [F.col("lo")], F.col("hi"), "before")
    begins = F.when(F.col("before").isNull() | fresh(F.col("lo"), F.col("before")), F.col("lo"))
    owned = last_value(behind.withColumn("begins", begins), ["k"], [F.col("lo")], F.col("begins"), "owner", F.col("lo"))
    return owned.groupBy("k", "owner").agg(F.max("hi").alias("hi"), F.sum("n").alias("n")).select("k", F.col("owner").alias("lo"), "hi", "n")
