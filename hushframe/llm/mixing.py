"""Mixing of overlapping sources to target weights by min-cost flow.

Sources overlap where they hold the same text. Documents whose text the same set of sources holds form one node, whose
capacity is the words of its texts, and each further use of them costs more. The cheapest flow from these nodes to the
sources' quotas says how many words each node gives to each source; documents are then taken in a seeded order up to
that many words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from itertools import cycle

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import FEW_ROWS, cut, if_few, word_array

WEIGHTS, SHARE, MAX_REPEATS = (3, 1, 2), 1.5, 2
#: The seeded place of a document is a number of this many bits; its cut is found by levels of LEVEL_BITS.
PLACE_BITS, LEVEL_BITS, LEVELS = 48, 12, 2
#: Levels of use that a pass of a round tries for each source.
STEPS = 16


@dataclass(frozen=True)
class Settings:
    seed: str = "mix-1"
    #: Pairs of a set of sources and one of them for which the driver runs the rounds of the flow; for more they run on the
    #: table, with the same numbers. Also the different arrays of sources that mix(docs, sources=...) takes.
    max_patterns: int = 2_000
    #: The rounds end when the words that one of them moves are at most this share of all words, or after so many.
    moved: float = 1e-3
    rounds: int = 60


def targets(sizes: dict[str | None, int], share: float = SHARE, limit: float = MAX_REPEATS, weights: tuple[float, ...] = WEIGHTS) -> dict[str | None, float]:
    """Words for each source: share of all sizes by weight, no source above limit times its size, the excess reshared.

    Sources are weighed in the order of their code points, null last.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, cycle(weights), strict=False))
    total, rest = share * sum(sizes.values()), sum(weight.values())
    out: dict[str | None, float] = {}
    for s in sorted(order, key=lambda s: limit * sizes[s] / weight[s]):
        if total / rest * weight[s] <= limit * sizes[s]:
            break
        out[s] = float(limit * sizes[s])
        total, rest = total - out[s], rest - weight[s]
    return {s: out.get(s, total / rest * weight[s] if s not in out else 0.0) for s in order}


def min_cost_flow(capacity: dict[tuple, int], quota: dict[str | None, int], repeats: int = MAX_REPEATS, limit: dict[tuple, int] | None = None) -> dict[tuple, dict[str | None, int]]:
    """Words from each set of sources to each source: as many as the quotas ask for, at the least cost of repetition.

    The k-th use of a set's words costs k * k. limit: the words that a set may give to one of its sources, by (set,
    source), in place of repeats for all of them together. Successive cheapest paths over sets, sources and back.
    """
    used = dict.fromkeys(capacity, 0)
    flow: dict[tuple, dict[str | None, int]] = {p: dict.fromkeys(p, 0) for p in capacity}
    holders: dict[str | None, list[tuple]] = defaultdict(list)
    for p in capacity:
        for s in p:
            holders[s].append(p)
    room = lambda p, s: (limit[p, s] - flow[p][s]) if limit else repeats * capacity[p]
    missing = dict(quota)
    for s in sorted(quota, key=lambda s: (s is None, s or "")):
        while missing[s] > 0:
            # Cheapest set that can give one more use, reached over sources that can hand over a set they hold.
            best, came, queue = None, {s: None}, [s]
            while queue and (best is None or best[0] > 1):
                at = queue.pop(0)
                for p in holders[at]:
                    if not capacity[p] or room(p, at) <= 0:
                        continue
                    use = used[p] // capacity[p] + 1
                    if (limit or use <= repeats) and (best is None or use < best[0]):
                        best = (use, p, at)
                    for other, held in flow[p].items():
                        if held and other not in came:
                            came[other] = (at, p)
                            queue.append(other)
            if best is None:
                break
            use, p, at = best
            path, words = [], min(missing[s], use * capacity[p] - used[p], room(p, at))
            while came[at] is not None:
                back, via = came[at]
                path.append((back, via, at))
                words = min(words, flow[via][at], room(via, back))
                at = back
            last = best[2]
            used[p] += words
            flow[p][last] += words
            for back, via, giver in path:  # giver takes the new words and hands its old ones on
                flow[via][giver] -= words
                flow[via][back] += words
            missing[s] -= words
    return flow


def _shown(source: Column) -> Column:
    """A source as text that differs from all others, null too."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def _pattern_key(sources: Column) -> Column:
    return F.array_join(F.transform(sources, _shown), "\x1f")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _sets_of_equal_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, pattern) of the texts with words that two sources or more hold, and (pattern, once, members): the words of
    the texts of each set of sources, once each, and the number of its sources.

    A pattern names a set by the number of its sources and 128 bits of their hashes, so that no set is gathered. Copies
    are counted by source before they meet.
    """
    size = F.size(word_array(docs["text"])).cast("long")
    texts = docs.select(_digest(docs["text"]).alias("digest"), _shown(docs["source"]).alias("source"), size.alias("size")).where("size > 0")
    by_source = cut(texts.groupBy("digest", "source").agg(F.max("size").alias("size")), "holders")
    bits = [F.hex(F.bit_xor(h)) for h in (F.xxhash64("source"), F.xxhash64(F.lit("again"), "source"))]
    sets = by_source.groupBy("digest").agg(F.count("*").alias("members"), F.concat_ws("-", *bits).alias("bits"), F.max("size").alias("size"))
    sets = cut(sets.where("members > 1").withColumn("pattern", F.concat_ws("-", F.col("members").cast("string"), "bits")), "sets")
    return sets.select("digest", "pattern"), sets.groupBy("pattern").agg(F.sum("size").alias("once"), F.first("members").alias("members"))


def _place(docs: DataFrame, seed: str) -> Column:
    """A seeded number of PLACE_BITS bits from id and text."""
    shown = F.concat(F.lit(seed + "|"), F.coalesce(docs["doc_id"].cast("string"), F.lit("-")), F.lit("|"), F.coalesce(docs["text"], F.lit("")))
    return F.conv(F.substring(F.md5(shown), 1, PLACE_BITS // 4), 16, 10).cast("long")


#: What a cell or set gives; quota: the words of all that its owner has together.
_PLAN = "key string, owner string, size long, words long, quota long, source_size long, target double"


def _plan_of_sets(spark: SparkSession, patterns: list[Row]) -> DataFrame:
    """_PLAN for each of patterns (key, sources, size), by the flow on the driver; each owns its words."""
    patterns.sort(key=lambda r: r["key"])
    capacity = {tuple(r["sources"]): r["size"] for r in patterns}
    source_size: dict[str | None, int] = defaultdict(int)
    for p, n in capacity.items():
        for s in p:
            source_size[s] += n
    target = targets(source_size)
    flow = min_cost_flow(capacity, {s: round(t) for s, t in target.items()})
    rows = []
    for r in patterns:
        p = tuple(r["sources"])
        first = p[0] if p else None
        rows.append((r["key"], r["key"], r["size"], sum(flow[p].values()), sum(flow[p].values()), source_size.get(first, 0), float(target.get(first, 0.0))))
    return spark.createDataFrame(rows, _PLAN)


def _targets_of_table(per: DataFrame) -> DataFrame:
    """(source, source_size, target) as targets finds them, for per (source, name, size) with any number of sources."""
    by_name = F.col("name").asc_nulls_last()
    listed = cut(per.repartitionByRange(by_name).sortWithinPartitions(by_name).withColumn("id", F.monotonically_increasing_id()), "sources")
    # The place of a source in the order: its row in the partition, behind the rows of the partitions before.
    parts = listed.groupBy(F.shiftright("id", 33).alias("part")).count().orderBy("part").collect()
    before, n = {0: 0}, 0
    for r in parts:
        before[r["part"]], n = n, n + r["count"]
    offset = F.get(F.lit([before.get(i, 0) for i in range(max(before) + 1)]), F.shiftright("id", 33).cast("int"))
    place = (offset + F.col("id").bitwiseAND((1 << 33) - 1)) % len(WEIGHTS)
    listed = listed.withColumn("weight", F.get(F.lit(list(WEIGHTS)), place.cast("int")))
    # Each round takes out the sources that the level would carry past their limit, which raises the level for the rest.
    sums = lambda d: d.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.count("*").alias("n")).first()
    every, full, limit = sums(listed), -1, F.col("size") * float(MAX_REPEATS)
    level = SHARE * every["size"] / max(every["weight"], 1)
    while full != (over := sums(listed.where(F.lit(level) * F.col("weight") > limit)))["n"]:
        full = over["n"]
        if full == every["n"]:
            break
        level = (SHARE * every["size"] - MAX_REPEATS * over["size"]) / (every["weight"] - over["weight"])
    return cut(listed.select("source", F.col("size").alias("source_size"), F.least(F.lit(level) * F.col("weight"), limit).alias("target")), "targets")


def with_targets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source) with the __size, __source_size and __target that mix gives them: doc_id and these three only.

    Targets depend on the sizes of sources alone; texts are read once and nothing else of them is kept, nor is a flow sought.
    """
    size = F.size(word_array(docs["text"])).cast("long")
    sizes = cut(docs.select("doc_id", docs["source"].alias("name"), _shown(docs["source"]).alias("source"), size.alias("size")), "sizes")
    target = _targets_of_table(sizes.groupBy("source").agg(F.first("name").alias("name"), F.sum("size").alias("size")))
    joined = sizes.join(if_few(target, target.count()), "source")
    return joined.select("doc_id", F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))


def _sum(words: Column) -> Column:
    """The sum in whole thousandths, which no order of the rows changes, so that reruns agree."""
    return F.sum(F.bround(words * 1000).cast("long")) / 1000


def _filled(cells: DataFrame, passes: int) -> DataFrame:
    """cells (source, node, once, members, size, target, z, used) with x: the words near z that sum to the target of each
    source, at most MAX_REPEATS times the size, and have the least level of use.

    A cell gives more with a rising level of its source; the level at which the target is met is searched by its bounds:
    each pass sums the words at STEPS + 1 levels for each source, with partial sums before the shuffle.
    """
    at = lambda level: F.least(F.col("size") * float(MAX_REPEATS), F.greatest(F.lit(0.0), F.col("z") + (F.col("once") * level - F.col("used")) / F.col("members")))
    low = F.min((F.col("used") - F.col("z") * F.col("members")) / F.col("once"))
    high = F.max((F.col("used") + (F.col("size") * float(MAX_REPEATS) - F.col("z")) * F.col("members")) / F.col("once"))
    found = cut(cells.groupBy("source").agg(low.alias("low"), high.alias("high")), "levels")
    for _ in range(passes):
        level = lambda i: F.col("low") + (F.col("high") - F.col("low")) * (i / STEPS)
        sums = [_sum(at(level(i))).alias(f"s{i}") for i in range(STEPS + 1)]
        summed = cells.join(found, "source").groupBy("source", "low", "high").agg(F.first("target").alias("target"), *sums)
        under = sum(((F.col(f"s{i}") < F.col("target")).cast("int") for i in range(1, STEPS)), F.lit(0))
        summed = summed.withColumns({"i": under, "s": F.array(*[f"s{i}" for i in range(STEPS + 1)]), "step": (F.col("high") - F.col("low")) / STEPS})
        below, above = F.get("s", F.col("i")), F.get("s", F.col("i") + 1)
        part = F.when(above > below, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("target") - below) / (above - below)))).otherwise(0.0)
        left = F.col("low") + F.col("step") * F.col("i")
        found = cut(summed.select("source", left.alias("low"), (left + F.col("step")).alias("high"), (left + F.col("step") * part).alias("level")), "levels")
    return cells.join(found.select("source", "level"), "source").withColumn("x", at(F.col("level"))).drop("level")


def _plan_of_table(cells: DataFrame, settings: Settings) -> DataFrame:
    """_PLAN for cells (key, node, source, name, size, once, members) of any number.

    Costs that rise with the level of use of a set lead to one optimum, whatever their form: that of the squares of use
    over capacity. It is approached by accelerated rounds, the last of which meets the targets: each source moves its words from
    its sets with a higher level of use to those with a lower one, by steps for which all sources of a set may move at once.
    """
    target = _targets_of_table(cells.groupBy("source").agg(F.first("name").alias("name"), F.sum("size").alias("size")))
    known = cut(cells.drop("name").join(target, "source").withColumn("x", F.col("target") * F.col("size") / F.greatest("source_size", F.lit(1))), "cells")
    columns = ["key", "owner", "size", "words", "quota", "source_size", "target"]
    words = F.least(F.bround("x").cast("long"), F.col("size") * MAX_REPEATS)
    plan = lambda d: d.withColumns({"owner": F.col("source"), "words": words, "quota": F.bround("target").cast("long")}).select(columns)
    overlapping = known.where("members > 1").select("source").distinct()
    if overlapping.isEmpty():
        return cut(plan(known), "plan")
    # A source that shares nothing has one cell, which its target fills; cells without words take none.
    fixed = known.join(overlapping, "source", "left_anti").union(known.join(overlapping, "source", "left_semi").where("size = 0"))
    state = cut(known.where("size > 0").join(overlapping, "source", "left_semi").withColumn("z", F.col("x")), "state")
    few = state.limit(settings.max_patterns + 1).count() <= settings.max_patterns
    return cut(plan(_rounds_on_driver(state, settings) if few else _rounds(state, settings)).union(plan(fixed)), "plan")


def _rounds(state: DataFrame, settings: Settings) -> DataFrame:
    """state (source, node, once, members, size, target, x, z, others) with the x of the last round."""
    for i in range(settings.rounds):
        used = state.groupBy("node").agg(_sum(F.col("z")).alias("used"))
        moving = cut(state.withColumnRenamed("x", "was").join(used, "node"), "moving")
        momentum = i / (i + 3)
        moved = _filled(moving, 2).withColumn("z", F.col("x") + momentum * (F.col("x") - F.col("was")))
        moved = cut(moved, "state")

        change = moved.agg(_sum(F.abs(F.col("x") - F.col("was"))).alias("moved"), _sum(F.col("x")).alias("all")).first()
        state = moved.drop("was", "used").select(state.columns)
        if change["moved"] <= settings.moved * change["all"]:
            break
    used = state.groupBy("node").agg(_sum(F.col("x")).alias("used"))
    return _filled(cut(state.withColumn("z", F.col("x")).join(used, "node"), "moving"), 5)


def _rounds_on_driver(state: DataFrame, settings: Settings) -> DataFrame:
    """As _rounds, for a state that fits the driver: the same operations on the same doubles, and sums in whole thousandths,
    so that both ways give one result to the last bit."""
    held = state.select("key", "source", "node", "once", "members", "size", "target", "x").toPandas()
    source, node = (np.unique(held[c].to_numpy(str), return_inverse=True)[1] for c in ("source", "node"))
    once, members, size, x = (held[c].to_numpy(float) for c in ("once", "members", "size", "x"))
    target, most = np.zeros(source.max() + 1), size * float(MAX_REPEATS)
    target[source] = held["target"]

    def total(words: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = np.zeros(by.max() + 1, np.int64)
        np.add.at(out, by, np.rint(words * 1000).astype(np.int64))
        return out / 1000

    def filled(z: np.ndarray, passes: int) -> np.ndarray:
        used = total(z, node)[node]
        at = lambda level: np.minimum(most, np.maximum(0.0, z + (once * level[source] - used) / members))
        low, high, every = np.full(len(target), np.inf), np.full(len(target), -np.inf), np.arange(len(target))
        np.minimum.at(low, source, (used - z * members) / once)
        np.maximum.at(high, source, (used + (most - z) * members) / once)
        for _ in range(passes):
            sums = np.array([total(at(low + (high - low) * (i / STEPS)), source) for i in range(STEPS + 1)])
            under = (sums[1:STEPS] < target).sum(axis=0)
            below, above, step = sums[under, every], sums[under + 1, every], (high - low) / STEPS
            part = np.where(above > below, np.clip((target - below) / np.where(above > below, above - below, 1.0), 0.0, 1.0), 0.0)
            left = low + step * under
            low, high, level = left, left + step, left + step * part
        return at(level)

    z, one = x, np.zeros(len(x), int)
    for i in range(settings.rounds):
        was, x = x, filled(z, 2)
        z = x + i / (i + 3) * (x - was)
        if total(np.abs(x - was), one)[0] <= settings.moved * total(x, one)[0]:
            break
    found = state.sparkSession.createDataFrame(list(zip(held["key"], filled(x, 5).tolist(), strict=True)), "key string, x double")
    return state.drop("x").join(F.broadcast(found), "key")


def mix(docs: DataFrame, sources: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """docs (doc_id, text, source, others) with __size, __source_size, __target, __copies and __taken.

    By default a document is its source's, and its text belongs to all sources that hold it; any number of sources may
    hold any number of texts, and the flow of few is found in the same rounds, number for number, as that of many. sources: the array of sources that a document itself belongs to, in place of that, for at
    most settings.max_patterns different arrays (an error beyond). __source_size and __target
    are those of the first of them. A null source is a source of its own; null or empty texts have size 0 and take no
    words; null ids have a place by their text; rows alike in id and text are taken together; an empty table
    gives no row; columns with the names of results are replaced, all others stay. Documents are taken in seeded order,
    each whole, so that the words that a source takes come within half a document (and a word) of its target.
    """
    spark, most = docs.sparkSession, settings.max_patterns
    size = F.size(word_array(docs["text"])).cast("long")
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), size.alias("size"), _place(docs, settings.seed).alias("place"), _digest(docs["text"]).alias("digest"), (F.array(docs["source"]) if sources is None else F.array_sort(F.array_distinct(sources))).alias("sources"))
    if sources is not None:
        marked = marked.withColumn("key", _pattern_key(F.col("sources")))
        narrow = cut(marked.select("key", "sources", "size", "place"), "sizes")
        patterns = narrow.groupBy("key").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")).limit(most + 1).collect()
        if len(patterns) > most:
            raise ValueError("more sets of sources than settings.max_patterns")
        return _taken(docs.columns, marked, narrow, _plan_of_sets(spark, patterns), True)
    # Texts without words are in no set; a digest of their own keeps them from meeting at one key.
    marked = marked.withColumns({"name": F.col("sources")[0], "source": _shown(F.col("sources")[0]), "digest": F.when(F.col("size") > 0, F.col("digest")).otherwise(F.hex("place").cast("binary"))})
    sets, shared = _sets_of_equal_texts(docs)
    marked = marked.join(if_few(sets, sets.count()), "digest", "left").withColumn("key", F.concat_ws("|", F.coalesce("pattern", F.lit("")), "source"))
    narrow = cut(marked.select("key", "pattern", "source", "name", "size", "place"), "sizes")
    cells = narrow.groupBy("key", "pattern", "source").agg(F.first("name").alias("name"), F.sum("size").alias("size")).join(shared, "pattern", "left")
    cells = cut(cells.select("key", F.coalesce("pattern", "key").alias("node"), "source", "name", "size", F.coalesce("once", "size").alias("once"), F.coalesce("members", F.lit(1)).alias("members")), "cells")
    plan = _plan_of_table(cells, settings)
    return _taken(docs.columns, marked, narrow, plan, plan.count() <= FEW_ROWS)


def _taken(columns: list[str], marked: DataFrame, narrow: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """The rows of marked (row, key, size, place) with what the plan takes of each. small: whether the plan may be broadcast.

    Words that are no whole number of copies are made up by documents with one copy more. All cells of an owner do so
    together, each document with the share of its cell, so that the owner comes within half a document of its words.
    """
    hint = F.broadcast if small else lambda d: d
    copies = F.expr("words div greatest(size, 1)")
    share = F.expr("(words - copies * size) / greatest(size, 1)")
    plan = plan.withColumn("copies", copies).withColumn("share", share)
    missing = F.max("quota") - F.sum(F.col("copies") * F.col("size"))
    left = plan.groupBy("owner").agg(F.least(missing, F.sum(F.when(F.col("share") > 0, F.col("size")))).alias("left"))
    some = narrow.select("key", "size", "place").join(hint(plan.where("share > 0").select("key", "owner", "share")), "key")
    some = some.select("owner", "size", _order(F.col("place"), F.col("share")).alias("place"))
    found = _cuts(some if small else cut(some, "some"), left.where("left > 0"), hint)
    plan = hint(plan.select("key", "owner", "copies", "share", "source_size", "target").join(hint(found), "owner", "left"))
    more = (F.col("share") > 0) & (_order(F.col("place"), F.col("share")) <= F.col("cut"))
    copies = F.col("copies") + F.when(more, 1).otherwise(0)
    results = {"__size": F.col("size"), "__source_size": F.col("source_size"), "__target": F.col("target"), "__copies": copies, "__taken": copies * F.col("size")}
    joined = marked.select("row", "key", "size", "place").join(plan, "key")
    return joined.select(*[F.col("row")[c].alias(c) for c in columns if c not in results], *[v.alias(k) for k, v in results.items()])


def _order(place: Column, share: Column) -> Column:
    """The order in which documents get one more copy, of PLACE_BITS bits: those under a cut near the middle are the share of each cell."""
    return F.shiftright(place - (share * float(1 << PLACE_BITS)).cast("long") + F.lit(1 << PLACE_BITS), 1)


def _cuts(docs: DataFrame, left: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(owner, cut): documents (owner, size, place) with a place up to cut get one more copy; no row where none does."""
    left = left.select("owner", "left", F.lit(0).cast("long").alias("head"))
    shift = PLACE_BITS
    by_owner = Window.partitionBy("owner").orderBy("next")
    for _ in range(LEVELS):
        # Sums by the next bits of the place, for the documents under the head found so far: at most 4096 rows an owner.
        bits, shift = shift, shift - LEVEL_BITS
        under = docs.join(hint(left), "owner").where(F.shiftright("place", bits) == F.col("head"))
        sums = under.groupBy("owner", "left", F.shiftright("place", shift).alias("next")).agg(F.sum("size").alias("size"))
        sums = sums.withColumn("upto", F.sum("size").over(by_owner.rowsBetween(Window.unboundedPreceding, 0)))
        found = sums.where("upto >= left and upto - size < left").groupBy("owner").agg(F.min_by(F.struct((F.col("left") - F.col("upto") + F.col("size")).alias("left"), F.col("next").alias("head")), "next").alias("x"))
        left = cut(found.select("owner", "x.left", "x.head"), "level")
    under = docs.join(hint(left), "owner").where(F.shiftright("place", shift) == F.col("head"))
    sums = under.groupBy("owner", "left", "head", F.col("place").alias("next")).agg(F.sum("size").alias("size"))
    sums = sums.withColumn("upto", F.sum("size").over(by_owner.rowsBetween(Window.unboundedPreceding, 0)))
    last = sums.groupBy("owner", "head").agg(F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("left"), F.col("next"))).alias("last"))
    return last.select("owner", F.coalesce("last", F.shiftleft("head", shift) - 1).alias("cut"))
