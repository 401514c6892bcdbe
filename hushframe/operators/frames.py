"""Areas that touch, made one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import cut
from .tiles import overlapping

Rect = tuple[int, int, int, int]
#: Rows of a key that are merged at once.
FEW = 64


def _overlap(a: Rect, b: Rect) -> int:
    return max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def _around(a: Rect, b: Rect) -> Rect:
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y


def merge_touching(rects: list[Rect]) -> list[Rect]:
    """Rectangles that touch become one where one holds the other or the box around them is at most 30 % larger
    than what they cover; the first pair in order merges, then all pairs are tried anew."""
    found = list(rects)

    def pair() -> tuple[int, int] | None:
        for i, a in enumerate(found):
            near = (a[0] - 1, a[1] - 1, a[2] + 2, a[3] + 2)
            for j in range(i + 1, len(found)):
                b = found[j]
                if _overlap(near, b):
                    common, box = _overlap(a, b), _around(a, b)
                    size_a, size_b = a[2] * a[3], b[2] * b[3]
                    if common in (size_a, size_b) or box[2] * box[3] <= (size_a + size_b - common) * 1.3:
                        return i, j
        return None

    while (at := pair()) is not None:
        found[at[0]] = _around(found[at[0]], found.pop(at[1]))
    return found


def _grouped(rects: DataFrame, key: str) -> DataFrame:
    """(key, rect, box): distinct rectangles, with a box around all that they might ever be merged with. Boxes of one key are
    equal or apart: each grows by those that it meets until none does."""
    around = lambda r: G.inflate(r, 1, 1)
    rows = rects.where(F.col(key).isNotNull() & F.col("rect").isNotNull()).select(key, "rect").distinct()
    # Even a rectangle of no area lies in its box.
    sound = G.rect(F.col("rect.x"), F.col("rect.y"), F.greatest(F.col("rect.w"), F.lit(0)), F.greatest(F.col("rect.h"), F.lit(0)))
    found = cut(rows.withColumn("box", around(sound)), "areas")
    moving = found
    while True:
        boxes = moving.select(key, F.col("box").alias("rect")).distinct()
        met = overlapping(boxes, boxes, key)
        edge = lambda f, c: f(F.col("b")[c])
        far = lambda c, size: F.max(F.col("b")[c] + F.col("b")[size])
        grown = met.groupBy(key, "a").agg(edge(F.min, "x").alias("l"), edge(F.min, "y").alias("t"), far("x", "w").alias("r"), far("y", "h").alias("d"))
        grown = cut(grown.select(F.col(key).alias("__key"), "a", G.ltrb(F.col("l"), F.col("t"), F.col("r"), F.col("d")).alias("to")).where("a <> to"), "areas-grown")
        if grown.isEmpty():
            return found
        # Only keys in which a box has grown are looked at again.
        found = cut(found.join(grown, (F.col(key) == F.col("__key")) & (F.col("box") == F.col("a")), "left").select(key, "rect", F.coalesce("to", "box").alias("box")), "areas")
        moving = found.join(grown.select(F.col("__key").alias(key)).distinct(), key, "left_semi")


def merged_areas(rects: DataFrame, key: str) -> DataFrame:
    """(key, rect): the rectangles of each key, those that touch made one as merge_touching does in the order of x, y, w and h.

    The rectangles of a key of up to FEW rows are gathered and merged at once. Those of larger keys are told apart first:
    rectangles whose boxes stay apart never meet, so that each group within one box is merged by itself, with the same result,
    and a key's areas fall to as many tasks as it has groups. Rectangles that all hang together are one group, of one task.
    Equal rectangles are one; null keys and rectangles are left out; no rows give none.
    """
    sound = rects.where(F.col(key).isNotNull() & F.col("rect").isNotNull()).select(key, "rect")
    large = cut(sound.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > FEW).select(key), "areas-large")
    gathered = lambda d, by: d.groupBy(*by).agg(F.array_sort(F.collect_set("rect")).alias("rects")).select(key, "rects")
    if large.isEmpty():
        groups = gathered(sound, [key])
    else:
        groups = gathered(sound.join(large, key, "left_anti"), [key]).unionByName(gathered(_grouped(sound.join(large, key, "left_semi"), key), [key, "box"]))

    @F.pandas_udf(f"array<{G.RECT}>")
    def merge(lists: pd.Series) -> pd.Series:
        one = lambda row: [dict(zip("xywh", r, strict=True)) for r in merge_touching([(q["x"], q["y"], q["w"], q["h"]) for q in row])]
        return lists.map(one)

    several = F.size("rects") > 1
    alone = groups.where(~several).select(key, F.get("rects", F.lit(0)).alias("rect"))
    return alone.unionByName(groups.where(several).select(key, F.explode(merge("rects")).alias("rect")))
