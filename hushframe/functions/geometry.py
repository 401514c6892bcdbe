"""Rectangles as struct<x,y,w,h> columns; right and bottom edges are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECT = "struct<x:int,y:int,w:int,h:int>"


def rect(x, y, w, h) -> Column:
    cols = [(c if isinstance(c, Column) else F.lit(c)).cast("int") for c in (x, y, w, h)]
    return F.struct(*[c.alias(n) for c, n in zip(cols, "xywh", strict=True)])


def ltrb(left, top, right, bottom) -> Column:
    return rect(left, top, right - left, bottom - top)


def right(r: Column) -> Column:
    return r["x"] + r["w"]


def bottom(r: Column) -> Column:
    return r["y"] + r["h"]


def is_empty(r: Column) -> Column:
    return (r["w"] <= 0) | (r["h"] <= 0)


def area(r: Column) -> Column:
    return F.when(is_empty(r), F.lit(0).cast("long")).otherwise(r["w"].cast("long") * r["h"].cast("long"))


def intersects(a: Column, b: Column) -> Column:
    return (a["x"] < right(b)) & (b["x"] < right(a)) & (a["y"] < bottom(b)) & (b["y"] < bottom(a))


def intersect(a: Column, b: Column) -> Column:
    """The common part, or the zero rectangle."""
    l, t = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    r, d = F.least(right(a), right(b)), F.least(bottom(a), bottom(b))
    return F.when((r > l) & (d > t), ltrb(l, t, r, d)).otherwise(rect(0, 0, 0, 0))


def contains(a: Column, b: Column) -> Column:
    """Whether b lies in a; an empty b lies in nothing."""
    return ~is_empty(b) & (b["x"] >= a["x"]) & (b["y"] >= a["y"]) & (right(b) <= right(a)) & (bottom(b) <= bottom(a))


def union(a: Column, b: Column) -> Column:
    """The box around both; an empty one adds nothing."""
    both = ltrb(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(right(a), right(b)), F.greatest(bottom(a), bottom(b)))
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(both)


def offset(r: Column, dx, dy) -> Column:
    return rect(r["x"] + dx, r["y"] + dy, r["w"], r["h"])


def inflate(r: Column, dx, dy) -> Column:
    return rect(r["x"] - dx, r["y"] - dy, r["w"] + 2 * dx, r["h"] + 2 * dy)


def scale_outward(r: Column, by) -> Column:
    return ltrb(F.floor(r["x"] * by), F.floor(r["y"] * by), F.ceil(right(r) * by), F.ceil(bottom(r) * by))


def iou(a: Column, b: Column) -> Column:
    """Common area over the area of both, 0 where they are apart."""
    common = area(intersect(a, b))
    return F.when(common == 0, F.lit(0.0)).otherwise(common / (area(a) + area(b) - common))


def subtract(rects: Column, cut: Column) -> Column:
    """array<rect> without cut: of each rectangle it meets, the top, bottom, left and right bands that stay."""

    def bands(r: Column) -> Column:
        i = intersect(r, cut)
        four = F.array(
            ltrb(r["x"], r["y"], right(r), i["y"]),
            ltrb(r["x"], bottom(i), right(r), bottom(r)),
            ltrb(r["x"], i["y"], i["x"], bottom(i)),
            ltrb(right(i), i["y"], right(r), bottom(i)),
        )
        return F.when(is_empty(i), F.array(r)).otherwise(F.filter(four, lambda b: ~is_empty(b)))

    return F.flatten(F.transform(rects, bands))


def subtract_all(rects: Column, cuts: Column) -> Column:
    return F.aggregate(cuts, rects, lambda rest, c: subtract(rest, c))


def clip(r: Column, visible: Column) -> Column:
    """array<rect>: the parts of r inside the visible rectangles."""
    return F.filter(F.transform(visible, lambda v: intersect(r, v)), lambda i: ~is_empty(i))


def total_area(rects: Column) -> Column:
    return F.aggregate(rects, F.lit(0).cast("long"), lambda a, r: a + area(r))


def coverage(target: Column, cover: Column) -> Column:
    """Share of target under the union of cover; 1 for an empty target."""
    rest = subtract_all(F.array(target), cover)
    return F.when(is_empty(target), F.lit(1.0)).otherwise(1 - total_area(rest) / area(target))


def pad(r: Column) -> Column:
    """A detection with a margin that grows with its height."""
    dx, dy = F.greatest(F.lit(4), F.floor(r["h"] * 0.4)), F.greatest(F.lit(3), F.floor(r["h"] * 0.3))
    return rect(r["x"] - dx, r["y"] - dy, r["w"] + 2 * dx, r["h"] + 2 * dy)


def predict(r: Column, velocity: Column, frame_time: Column, interval: Column, target: Column) -> Column:
    """Where a rectangle that moves at velocity pixels a ms stands at the target time, for a short while ahead."""
    elapsed, iv = target - frame_time, F.least(interval, F.lit(40.0))
    horizon = iv * 1.5 + 30
    still = velocity.isNull() | F.isnan(velocity) | (F.abs(velocity) < 0.01) | (elapsed <= 0) | (elapsed > horizon + iv)
    dy = F.bround(velocity * F.least(elapsed, horizon))
    return F.when(still, r).otherwise(offset(r, 0, dy))


def colour(text: Column) -> Column:
    """#RRGGBB as a number, null for anything else."""
    digits = F.regexp_replace(F.trim(text), "^#+", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), F.conv(digits, 16, 10).cast("long"))


def ink(rgb: Column) -> Column:
    """Dark text for colours of more than 0.6 of full luminance, white for others."""
    r, g, b = (F.shiftright(rgb, s).bitwiseAND(255) for s in (16, 8, 0))
    return F.when((0.2126 * r + 0.7152 * g + 0.0722 * b) / 255 > 0.6, F.lit("#1A1A1A")).otherwise(F.lit("#FFFFFF"))


def hsv(rgb: Column) -> Column:
    """struct<h,s,v> of a colour: degrees, and shares of 1."""
    r, g, b = (F.shiftright(rgb, s).bitwiseAND(255) / 255 for s in (16, 8, 0))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, F.lit(0.0)).when(top == r, 60 * F.pmod((g - b) / d, F.lit(6.0))).when(top == g, 60 * ((b - r) / d + 2)).otherwise(60 * ((r - g) / d + 4))
    return F.struct(h.alias("h"), F.when(top == 0, F.lit(0.0)).otherwise(d / top).alias("s"), top.alias("v"))


def rgb(h: Column, s: Column, v: Column) -> Column:
    """The colour with this hue, saturation and value, as a number."""

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 60, F.lit(6.0))
        return F.round(255 * (v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0))))).cast("long")

    return channel(5) * 65536 + channel(3) * 256 + channel(1)
