"""Windows on a screen: which rules cover them, what of them is visible, and what must be covered."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .rules import Rule, active

# Window classes of the shell that are never watched.
IGNORED_CLASSES = ("Progman", "WorkerW", "Shell_TrayWnd", "Shell_SecondaryTrayWnd", "Windows.UI.Core.CoreWindow", "ForegroundStaging", "MultitaskingViewFrame")
# Fixed values end here.
MAX_WATCHED, LEAST_VISIBLE, LEAST_SIDE = 8, 2000, 8


def matches_any(title: Column, process: Column, rules: Iterable[Rule]) -> Column:
    """Whether an enabled window rule's text stands in the title or the process name, whatever the case."""
    hit = F.lit(False)
    for r in active(rules):
        if r.kind == "AppWindow":
            needle = r.pattern.strip().lower()
            hit = hit | F.coalesce(F.lower(title).contains(needle), F.lit(False)) | F.coalesce(F.lower(process).contains(needle), F.lit(False))
    return hit


def matching_windows(windows: DataFrame, rules: DataFrame, anti: bool = False) -> DataFrame:
    """windows (title, process) that some row of rules (pattern) names, or that none does.

    The rules are a small table by its nature: a semi join on a condition.
    """
    wanted = rules.where("enabled and kind = 'AppWindow' and length(trim(pattern)) >= 3").select(F.lower(F.trim("pattern")).alias("needle")).distinct()
    hit = F.lower(F.coalesce("title", F.lit(""))).contains(F.col("needle")) | F.lower(F.coalesce("process", F.lit(""))).contains(F.col("needle"))
    return windows.join(wanted, hit, "left_anti" if anti else "left_semi")


def usable(windows: DataFrame) -> DataFrame:
    """Windows that are shown, large enough and not of the shell."""
    return windows.where((F.col("rect.w") >= LEAST_SIDE) & (F.col("rect.h") >= LEAST_SIDE) & ~F.col("class").isin(*IGNORED_CLASSES))


def visible_regions(windows: DataFrame, screen: Column, key: str = "screen_id") -> DataFrame:
    """windows (key, window_id, z, rect, opaque) with visible: their parts on the screen that no opaque window above covers.

    A screen holds few windows, which meet in one row.
    """
    above = Window.partitionBy(key).orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    covers = F.collect_list(F.when(F.col("opaque"), F.col("rect"))).over(above)
    on_screen = F.filter(F.array(G.intersect(F.col("rect"), screen)), lambda r: ~G.is_empty(r))
    return windows.withColumn("covers", covers).withColumn("visible", G.subtract_all(on_screen, F.col("covers"))).drop("covers")


def watched(windows: DataFrame, rules: Iterable[Rule], key: str = "screen_id") -> DataFrame:
    """Of windows with visible: those covered whole by a rule, and the first MAX_WATCHED others with enough to see."""
    w = windows.withColumn("covered", matches_any(F.col("title"), F.col("process"), rules))
    enough = w.where(F.col("covered") | (G.total_area(F.col("visible")) >= LEAST_VISIBLE))
    rank = F.row_number().over(Window.partitionBy(key, "covered").orderBy("z"))
    return enough.withColumn("rank", rank).where(F.col("covered") | (F.col("rank") <= MAX_WATCHED)).drop("rank")


def compose(boxes: DataFrame, windows: DataFrame, target_ms: Column) -> DataFrame:
    """(window_id, rect): what to cover on the screen.

    boxes: window_id, rect in the window, velocity, frame_time_ms, interval_ms; windows: window_id, rect, visible, covered.
    A covered window gives all its visible parts, any other its boxes where they are by now.
    """
    w = windows.select("window_id", F.col("rect").alias("bounds"), "visible", "covered")
    whole = w.where("covered").select("window_id", F.explode("visible").alias("rect"))
    placed = boxes.join(w.where("not covered"), "window_id")
    return whole.unionByName(placed_parts(placed, target_ms).select("window_id", F.col("part").alias("rect")))


def placed_parts(rows: DataFrame, target_ms: Column) -> DataFrame:
    """rows with part, as compose: each holds a box (rect, velocity, frame_time_ms, interval_ms) and its window (bounds, visible,
    covered); a row of a covered window gives all the visible parts. Where a table holds boxes with their windows, nothing is joined."""
    moved = G.predict(F.col("rect"), F.col("velocity"), F.col("frame_time_ms"), F.col("interval_ms"), target_ms)
    now = rows.withColumn("now", G.offset(moved, F.col("bounds.x"), F.col("bounds.y")))
    parts = F.when(F.col("covered"), F.col("visible")).otherwise(G.clip(G.intersect(F.col("now"), F.col("bounds")), F.col("visible")))
    return now.withColumn("part", F.explode(parts)).drop("now")


def preview(open_windows: DataFrame, pattern: str, most: int = 5) -> DataFrame:
    """(name): titles, or process names where there is no title, that a window rule with this pattern would cover; a few of them."""
    hit = matches_any(F.col("title"), F.col("process"), [Rule("AppWindow", pattern)])
    name = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.col("title")).otherwise(F.col("process"))
    return open_windows.where(hit).select(name.alias("name")).distinct().orderBy("name").limit(most)


def totals(boxes: DataFrame, rules: DataFrame) -> DataFrame:
    """(hidden, windows, enabled_rules): boxes, windows with any, and rules that are on: one row."""
    on = rules.agg(F.count_if("enabled").alias("enabled_rules"))
    seen = boxes.agg(F.count("*").alias("hidden"), F.count_distinct("window_id").alias("windows"))
    return seen.withColumn("one", F.lit(1)).join(on.withColumn("one", F.lit(1)), "one").drop("one")
