"""From character spans to rectangles: words with boxes, lines of words, and the matches in their text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import cut
from .detect import with_matches
from .rules import Rule

TIGHT = 0.22
#: Characters of a stretch of a document's text, in which words and matches meet.
STRETCH = 256


def words_with_spans(words: DataFrame, join_tight: bool) -> DataFrame:
    """words (doc_id, line, word_ix, text, x, y, width, height) with start and end in the text that they make.

    Words of a line are joined by a space, tight ones by nothing if join_tight; lines are joined by line ends.
    """
    in_line = Window.partitionBy("doc_id", "line").orderBy("word_ix")
    in_doc = Window.partitionBy("doc_id").orderBy("line", "word_ix")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(in_line)
    tall = F.greatest("height", F.lag("height").over(in_line))
    w = words.withColumn("tight", F.coalesce(gap < tall * TIGHT, F.lit(False)))
    first = F.row_number().over(in_line) == 1
    between = F.when(F.row_number().over(in_doc) == 1, "").when(first, "\n").when(F.col("tight") & F.lit(join_tight), "").otherwise(" ")
    w = w.withColumn("between", between)
    w = w.withColumn("end", F.sum(F.length("between") + F.length("text")).over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return w.withColumn("start", F.col("end") - F.length("text"))


def word_rows(words: DataFrame) -> DataFrame:
    """(doc_id, words) of words (doc_id, line, word_ix, text, x, y, width, height): an array in the order of lines and words.

    A document is the unit of one crop and fits a row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line", "word_ix", "text", "x", "y", "width", "height")))
    return words.groupBy("doc_id").agg(ordered.alias("words"))


def _is_tight(words: Column, i: Column) -> Column:
    """Whether the word at i follows the one before it in its line with hardly a gap."""
    w, last = F.get(words, i), F.get(words, i - 1)
    gap = w["x"] - (last["x"] + last["width"])
    return last["line"].eqNullSafe(w["line"]) & F.coalesce(gap < F.greatest(w["height"], last["height"]) * TIGHT, F.lit(False))


def _row_text(words: Column, join_tight: bool) -> Column:
    """The text that an array of words makes, as words_with_spans counts it."""

    def piece(w: Column, i: Column) -> Column:
        first = ~F.get(words, i - 1)["line"].eqNullSafe(w["line"])
        between = F.when(i == 0, "").when(first, "\n").when(_is_tight(words, i) & F.lit(join_tight), "").otherwise(" ")
        return F.concat(between, w["text"])

    return F.array_join(F.transform(words, piece), "")


def line_boxes(words: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_id, rule_id, start, length, line, l, t, r, b): for each match and line, the box around what it covers of its words.

    A document's words and matches meet in stretches of its text, each pair in the stretch where it begins, so that a long
    document with many matches neither compares them all nor falls to one task.
    """

    def stretches(first, last):
        return F.explode(F.sequence(F.floor(first / STRETCH), F.floor(F.greatest(first, last - 1) / STRETCH)))

    m = matches.select(F.col("doc_id").alias("m_doc"), "rule_id", F.col("start").alias("m_start"), F.col("length").alias("m_length"))
    m = m.withColumn("m_at", stretches(F.col("m_start"), F.col("m_start") + F.col("m_length")))
    w = words.withColumn("at", stretches(F.col("start"), F.col("end")))
    meet = (F.col("start") < F.col("m_start") + F.col("m_length")) & (F.col("m_start") < F.col("end"))
    pairs = w.join(m, (F.col("doc_id") == F.col("m_doc")) & (F.col("at") == F.col("m_at")) & meet)
    pairs = pairs.where(F.floor(F.greatest("start", "m_start") / STRETCH) == F.col("at"))
    size = F.greatest(F.lit(1), F.col("end") - F.col("start"))
    since = F.greatest("start", "m_start") - F.col("start")
    until = F.least("end", F.col("m_start") + F.col("m_length")) - F.col("start")
    parts = pairs.select("doc_id", "rule_id", F.col("m_start").alias("start"), F.col("m_length").alias("length"), "line", (F.col("x") + F.col("width") * since / size).alias("x0"), (F.col("x") + F.col("width") * until / size).alias("x1"), "y", (F.col("y") + F.col("height")).alias("y1"))
    return parts.groupBy("doc_id", "rule_id", "start", "length", "line").agg(F.min("x0").alias("l"), F.min("y").alias("t"), F.max("x1").alias("r"), F.max("y1").alias("b"))


def _merge_same_rule(found):
    """Fold in order: a box joins the first kept one that it meets."""
    empty = F.array().cast(f"array<{G.RECT}>")

    def add(acc, r):
        at = F.array_position(F.transform(acc, lambda k: G.intersects(k, r)), True).cast("int")
        grown = F.transform(acc, lambda k, i: F.when(i + 1 == at, G.union(k, r)).otherwise(k))
        return F.when(at > 0, grown).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(found, empty, add)


def map_to_boxes(words: DataFrame, rules: Iterable[Rule], scale: float = 1.0, dx: int = 0, dy: int = 0) -> DataFrame:
    """(doc_id, rule_id, rect): boxes of all matches, from the words as they are and then with tight words joined.

    Boxes of one rule that meet become one, in the order of passes, matches and lines.
    """
    return map_rows_to_boxes(word_rows(words), rules, scale, dx, dy)


def map_rows_to_boxes(rows: DataFrame, rules: Iterable[Rule], scale: float = 1.0, dx: int = 0, dy: int = 0) -> DataFrame:
    """As map_to_boxes, from rows (doc_id, words) as word_rows makes them. Texts are made and searched row by row; only the
    words of documents in which something is found are written and shuffled."""
    rules, passes = list(rules), []
    for tight in (False, True):
        texts = rows
        if tight:  # only documents with tight words are read twice
            texts = rows.where(F.exists(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1))), lambda i: _is_tight(F.col("words"), i)))
        # An explode of one row keeps Spark from writing the text, or the matches, out anew wherever they are used.
        found = with_matches(texts.select("doc_id", "words", F.explode(F.array(_row_text(F.col("words"), tight))).alias("text")), "text", rules)
        found = found.select("doc_id", "words", F.explode(F.array(F.transform("matches", lambda m: m.dropFields("text")))).alias("matches"))
        found = cut(found.where(F.size("matches") > 0), "boxes-found")
        spanned = words_with_spans(found.select("doc_id", "words").repartition("doc_id").select("doc_id", F.inline("words")), tight)
        matches = found.select("doc_id", F.inline("matches"))
        passes.append(line_boxes(spanned, matches).withColumn("pass", F.lit(int(tight))))
    boxes = passes[0].unionByName(passes[1])
    r = G.ltrb(F.floor(F.col("l") / scale) + dx, F.floor(F.col("t") / scale) + dy, F.ceil(F.col("r") / scale) + dx, F.ceil(F.col("b") / scale) + dy)
    boxes = boxes.withColumn("rect", r).where(~G.is_empty(F.col("rect")))
    order = F.array_sort(F.collect_list(F.struct("pass", "start", (-F.col("length")).alias("shorter"), "line", "rect")))
    merged = boxes.groupBy("doc_id", "rule_id").agg(order.alias("found"))
    return merged.select("doc_id", "rule_id", F.explode(_merge_same_rule(F.transform("found", lambda f: f["rect"]))).alias("rect"))
