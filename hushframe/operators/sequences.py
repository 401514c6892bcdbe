"""Analytics over sequences of rows: rates, decay, running shifts, minima, runs and retention."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import prefixes


def _pieces(df: DataFrame, key: str, order: str, value: str, piece, made: str) -> DataFrame:
    """(key, pieces): rows are dealt by ranges of key and order, so that a large key falls to many tasks. Each task folds its
    rows of a key, in order, to one piece with the fields of made; the array has them in order, one for each task at most.

    piece(continues) gives an object with add(value) and result(); continues: the key may have begun in an earlier task.
    """
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("at"), F.col(value).alias("v"))
    schema = StructType([*rows.schema.fields[:2], *StructType.fromDDL(made).fields])
    types = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, at, state, done = None, None, None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t.type) for i, t in enumerate(types)], schema=types)

        for batch in batches:
            first = batch.column(1)
            for i, (k, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if state is None or not (k == key_now or (k != k and key_now != key_now)):
                    if state is not None:
                        done.append((key_now, at, *state.result()))
                    key_now, at, state = k, first[i].as_py(), piece(state is None)
                state.add(v)
            if len(done) >= 1000:
                yield flush()
                done.clear()
        if state is not None:
            done.append((key_now, at, *state.result()))
            yield flush()

    folded = rows.repartitionByRange("k", "at").sortWithinPartitions("k", "at").mapInArrow(fold, schema)
    return folded.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", *schema.names[2:]))).alias("pieces")).withColumnRenamed("k", key)


class _Smooth:
    """Of a stretch of values: what it makes of nothing, and of an average before it that is scaled and added to.

    A null leaves no average, so that the next value starts anew; no scale then.
    """

    def __init__(self, keep: float) -> None:
        self.keep, self.scale, self.plus, self.alone = keep, 1.0, 0.0, None

    def add(self, x: float | None) -> None:
        if x is None:
            self.scale = self.alone = None
            return
        new = x * (1 - self.keep)
        self.alone = x if self.alone is None else self.alone * self.keep + new
        if self.scale is not None:
            # Never down to 0: an infinite average stays infinite.
            self.scale = max(self.scale * self.keep, 5e-324 if self.keep else 0.0)
            self.plus = self.plus * self.keep + new

    def result(self) -> tuple:
        return self.scale, self.plus, self.alone


def ema(df: DataFrame, key: str, order: str, value: str, keep: float = 0.8) -> DataFrame:
    """(key, ema): the first value, then keep of the old and the rest of the new, in order."""
    values = df.select(key, F.struct(order, value).alias("at"), F.col(value).cast("double").alias("v"))
    found = _pieces(values, key, "at", "v", lambda continues: _Smooth(keep), "scale double, plus double, alone double")
    smooth = lambda a, p: F.when(a.isNull() | p["scale"].isNull(), p["alone"]).otherwise(a * p["scale"] + p["plus"])
    return found.select(key, F.aggregate("pieces", F.lit(None).cast("double"), smooth).alias("ema"))


def running_sum(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value up to and with each row of its key, in order; the first of order is a number or a time.

    A large key falls to many tasks, by parts of its order.
    """
    return prefixes.running_sum(prefixes.with_part(df, order[0]), [key], [F.col(c) for c in order], F.col(value), name).drop(prefixes.PART)


def rates(df: DataFrame, time: str, keys: list[str], least_seconds: float = 0.5) -> DataFrame:
    """(keys, second, n, rate): rows in each second, over its observed length or least_seconds."""
    second = F.date_trunc("second", F.col(time)).alias("second")
    g = df.groupBy(*keys, second).agg(F.count("*").alias("n"), (F.max(F.unix_micros(time)) - F.min(F.unix_micros(time))).alias("us"))
    return g.select(*keys, "second", "n", (F.col("n") / F.greatest(F.col("us") / 1e6, F.lit(least_seconds))).alias("rate"))


def local_minima(df: DataFrame, key: str, order: list[str], value: str, best: int = 40) -> DataFrame:
    """Rows not above either neighbour, the best of each key by value and then order."""
    w = Window.partitionBy(key).orderBy(*order)
    v = F.col(value)
    low = (v <= F.coalesce(F.lag(v).over(w), v)) & (v <= F.coalesce(F.lead(v).over(w), v))
    found = df.withColumn("low", low).where("low").drop("low")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(value, *order))).where(F.col("rank") <= best)


def decayed(heat: Column, elapsed_ms: Column, half_life_ms: float = 250.0) -> Column:
    """Heat in whole steps after some time: it halves with each half-life."""
    return F.shiftright((heat * F.floor(256 * F.pow(F.lit(0.5), elapsed_ms / half_life_ms))).cast("long"), 8)


class _Heat:
    """Of a stretch of events: its first and last time, and the heat after it for each heat from 0 to cap left at its first event.

    Only one heat where all end alike, or where the key begins here.
    """

    def __init__(self, continues: bool, gain: int, cap: int, half_life_ms: float) -> None:
        self.gain, self.cap, self.half_life_ms = gain, cap, half_life_ms
        self.heat, self.first, self.last, self.n = np.arange(cap + 1) if continues else 0, None, None, 0

    def add(self, t: int | None) -> None:
        if not self.n:
            self.first = t
        elif t is not None and self.last is not None and t > self.last:
            self.heat = self.heat * math.floor(256 * 0.5 ** ((t - self.last) / self.half_life_ms)) >> 8
        self.last, self.n = t, self.n + 1
        if isinstance(self.heat, int):
            self.heat = min(self.cap, self.heat + self.gain)
        else:
            self.heat = np.minimum(self.cap, self.heat + self.gain)
            if self.heat[0] == self.heat[-1]:  # a hotter start never ends colder
                self.heat = int(self.heat[0])

    def result(self) -> tuple:
        return self.first, self.last, [self.heat] if isinstance(self.heat, int) else self.heat.tolist()


def heat(df: DataFrame, key: str, time_ms: str, order: str, gain: int = 48, cap: int = 255, hot: int = 120, half_life_ms: float = 250.0) -> DataFrame:
    """(key, heat, hot): each event adds gain up to cap, and heat decays between events."""
    zero = F.struct(F.lit(0).cast("long").alias("heat"), F.lit(None).cast("long").alias("last"))

    def add(s: Column, p: Column) -> Column:
        kept = decayed(s["heat"], F.coalesce(p["first"] - s["last"], F.lit(0)), half_life_ms)
        return F.struct(F.get(p["heats"], F.when(F.size(p["heats"]) > 1, kept).otherwise(0).cast("int")).alias("heat"), p["last"].alias("last"))

    times = df.select(key, F.struct(time_ms, order).alias("at"), F.col(time_ms).cast("long").alias("t"))
    pieces = _pieces(times, key, "at", "t", lambda continues: _Heat(continues, gain, cap, half_life_ms), "first long, last long, heats array<long>")
    return pieces.select(key, F.aggregate("pieces", zero, add, lambda s: s["heat"]).alias("heat")).withColumn("hot", F.col("heat") >= hot)


def debounced(df: DataFrame, key: str, time_ms: str, order: str, settle_ms: int) -> DataFrame:
    """Rows after which the key was quiet for settle_ms: the moments when a change has settled."""
    following = F.lead(time_ms).over(Window.partitionBy(key).orderBy(time_ms, order))
    return df.where(F.lit(True)).withColumn("next_ms", following).where(F.col("next_ms").isNull() | (F.col("next_ms") - F.col(time_ms) >= settle_ms)).drop("next_ms")


def unexpired(df: DataFrame, key: str, time_ms: str, order: str, ttl_ms: int, most: int) -> DataFrame:
    """Per key, what is remembered at its last event: rows of the last ttl_ms, the newest of them if there are more than most."""
    w = Window.partitionBy(key)
    aged = df.withColumn("age", F.max(time_ms).over(w) - F.col(time_ms)).where(F.col("age") <= ttl_ms)
    return aged.withColumn("recency", F.row_number().over(w.orderBy(F.desc(time_ms), F.desc(order)))).where(F.col("recency") <= most)


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; only it is kept while aggregating."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def runs(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, first, last): stretches of consecutive positions."""
    places = df.select(F.struct(*keys).alias("key"), F.col(position).alias("lo"), (F.col(position) + 1).alias("hi")).where("lo is not null").distinct()
    return interval_union(places, "key", "lo", "hi").select("key.*", F.col("lo").alias("first"), (F.col("hi") - 1).cast(df.schema[position].dataType).alias("last"))


def interval_union(df: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """(key, lo, hi): the union of half-open intervals, by parts of a key."""
    rows = df.select(F.col(key).alias("k"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.lit(1).alias("n"))
    return prefixes.stretches(rows, lambda a, reach: a > reach).select(F.col("k").alias(key), "lo", "hi")


def interval_gaps(df: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """(key, lo, hi): what lies between the intervals of each key."""
    u = interval_union(df, key, lo, hi)
    following = F.lead("lo").over(Window.partitionBy(key).orderBy("lo"))
    return u.select(key, F.col("hi").alias("lo"), following.alias("next")).where("next is not null").select(key, "lo", F.col("next").alias("hi"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; -1 where either hardly varies."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    ma, mb = total(a) / n, total(b) / n
    cov = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    va, vb = total(F.transform(a, lambda x: (x - ma) * (x - ma))), total(F.transform(b, lambda y: (y - mb) * (y - mb)))
    return F.when((va < 1e-12) | (vb < 1e-12), F.lit(-1.0)).otherwise(cov / F.sqrt(va * vb))


def texture(a: Column) -> Column:
    """Sum of the absolute steps of an array."""
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.abs(F.get(a, i) - F.get(a, i - 1))), F.lit(0.0), lambda s, v: s + v)


def mean_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def last_rows(df: DataFrame, key: str, order: list[str], most: int = 12) -> DataFrame:
    """(key, log): the last rows of each key in order, as an array of structs of all other columns."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    kept = df.withColumn("__n", newest).where(F.col("__n") <= most).drop("__n")
    rest = [c for c in df.columns if c not in (key, *order)]
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("log"))


def busy(df: DataFrame, key: str, order: str, idle: str, total: str, most: float = 0.75) -> DataFrame:
    """df with share and busy: of the growth of a total counter since the row before, the part that was not idle."""
    w = Window.partitionBy(key).orderBy(order)
    grown, slept = F.col(total) - F.lag(total).over(w), F.col(idle) - F.lag(idle).over(w)
    share = F.when(grown > 0, 1 - slept / grown)
    return df.withColumn("share", share).withColumn("busy", F.coalesce(F.col("share") > most, F.lit(False)))


def interval_difference(df: DataFrame, gone: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """(key, lo, hi): what of df's intervals no interval of gone covers: stretches between all ends that only df is over."""
    change = lambda d, side: d.select(key, F.explode(F.array(F.struct(F.col(lo).alias("at"), F.lit(1).alias("step")), F.struct(F.col(hi).alias("at"), F.lit(-1).alias("step")))).alias("e")).select(key, "e.at", (F.col("e.step") if side == 0 else F.lit(0)).alias("a"), (F.col("e.step") if side else F.lit(0)).alias("b"))
    ends = change(df, 0).unionByName(change(gone, 1)).groupBy(key, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(key).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    stretches = ends.select(key, F.col("at").alias("lo"), F.lead("at").over(w).alias("hi"), F.sum("a").over(so_far).alias("a"), F.sum("b").over(so_far).alias("b"))
    return interval_union(stretches.where("a > 0 and b = 0 and hi is not null").select(key, F.col("lo").alias("l"), F.col("hi").alias("h")), key, "l", "h")
