"""Rectangles that meet: a spatial join by tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import cut

#: Rectangles of one tile, of one side, that one task compares with those of the other; more are dealt to several.
CROWD = 2000
#: Different rectangles of a key, of one side, that are compared without tiles.
FEW = 256


def _levelled(rects: DataFrame, levels: list[int]) -> DataFrame:
    """rects (key, r) with own (the level whose tiles, of side 2 to its power, are as large as r) and one row for each tile
    of each level from own up that r lies in: four at most a level, whatever its size."""
    own = F.ceil(F.log2(F.greatest(F.col("r.w"), F.col("r.h")).cast("double"))).cast("int")
    up = F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n >= F.col("own"))
    level = rects.withColumn("own", own).withColumn("level", F.explode(up))
    side = F.expr("shiftleft(1L, level)")
    span = lambda start, size: F.explode(F.sequence(F.floor(start / side), F.floor((start + size - 1) / side)))
    return level.withColumn("tx", span(F.col("r.x"), F.col("r.w"))).withColumn("ty", span(F.col("r.y"), F.col("r.h")))


def _own_levels(rects: DataFrame) -> list[int]:
    own = F.ceil(F.log2(F.greatest(F.col("r.w"), F.col("r.h")).cast("double"))).cast("int")
    return sorted(row[0] for row in rects.select(own).distinct().collect())  # 32 at most


def _classes(rects: DataFrame, key: str, rect: Column) -> DataFrame:
    """(key, r, n): the distinct rectangles of a key that are not empty, and how many rows have each."""
    return rects.select(F.col(key).alias("key"), rect.alias("r")).where("key is not null and r.w > 0 and r.h > 0").groupBy("key", "r").agg(F.count("*").alias("n"))


def overlapping(left: DataFrame, right: DataFrame, key: str, rect: str = "rect", once: bool = False) -> DataFrame:
    """(key, a, b, n_a, n_b): all pairs of different or equal rectangles a of left and b of right, within a key, that have a
    common area, once each, with how many rows of their side have a and b. Rows with one rectangle are one class, so that
    copies do not multiply pairs; a join on (key, a) gives the rows back. once: only pairs with a less than b.

    Keys of up to FEW different rectangles a side are compared by a plain join. In larger ones, each rectangle lies in a few tiles about as large as itself, and in those of the sizes above that others have. Two
    rectangles are compared in the tiles of the larger one's size; the pair counts in the tile that holds the upper left
    corner of their common part. Crowded tiles are dealt to several tasks: the left side in shares, the right side to each.
    Empty rectangles and null keys or rectangles meet nothing.
    """
    a = cut(_classes(left, key, F.col(rect)), "tiles-left")
    b = a if right is left else cut(_classes(right, key, F.col(rect)), "tiles-right")
    columns = [F.col("key").alias(key), "a", "b", "n_a", "n_b"]
    wanted = G.intersects(F.col("a"), F.col("b"))
    if once:
        wanted = wanted & (F.col("a") < F.col("b"))
    counts = a.groupBy("key").count()
    counts = counts if b is a else counts.unionByName(b.groupBy("key").count())
    large = cut(counts.where(F.col("count") > FEW).select("key").distinct(), "tiles-large")
    side_a, side_b = F.col("r").alias("a"), F.col("r").alias("b")
    plain = lambda a, b: a.select("key", side_a, F.col("n").alias("n_a")).join(b.select("key", side_b, F.col("n").alias("n_b")), "key").where(wanted).select(columns)
    if large.isEmpty():
        return plain(a, b)
    few = plain(a.join(large, "key", "left_anti"), b.join(large, "key", "left_anti"))
    a, b = a.join(large, "key", "left_semi"), b.join(large, "key", "left_semi")
    levels = sorted({*_own_levels(a), *_own_levels(b)})
    tile = ["key", "level", "tx", "ty"]
    of_left = _levelled(a, levels).select(*tile, F.col("r").alias("a"), F.col("n").alias("n_a"), F.col("own").alias("own_a"))
    of_right = _levelled(b, levels).select(*tile, F.col("r").alias("b"), F.col("n").alias("n_b"), F.col("own").alias("own_b"))
    crowded = cut(of_left.groupBy(*tile).agg(F.ceil(F.count("*") / CROWD).cast("int").alias("shares")).where("shares > 1"), "tiles-crowded")
    if crowded.isEmpty():
        of_left, of_right = of_left.withColumn("share", F.lit(0)), of_right.withColumn("share", F.lit(0))
    else:
        shares = F.coalesce("shares", F.lit(1))
        of_left = of_left.join(crowded, tile, "left").withColumn("share", F.pmod(F.xxhash64("a"), shares).cast("int")).drop("shares")
        of_right = of_right.join(crowded, tile, "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
    met = of_left.join(of_right, [*tile, "share"]).where((F.greatest("own_a", "own_b") == F.col("level")) & wanted)
    side = F.expr("shiftleft(1L, level)")
    corner = lambda c: F.floor(F.greatest(F.col("a")[c], F.col("b")[c]) / side)
    return few.unionByName(met.where((corner("x") == F.col("tx")) & (corner("y") == F.col("ty"))).select(columns))


def touched(rows: DataFrame, areas: DataFrame, key: str, rect: str = "rect") -> DataFrame:
    """The rows whose rectangle has a common area with some rectangle of areas, of the same key."""
    hit = overlapping(rows, areas, key, rect).select(F.col(key).alias("__key"), F.col("a").alias("__hit")).distinct()
    return rows.join(hit, (F.col(key) == F.col("__key")) & (F.col(rect) == F.col("__hit")), "left_semi")
