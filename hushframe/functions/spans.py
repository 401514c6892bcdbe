"""Positions of matches, span algebra and masking as column expressions.

Offsets count code points from 0; spans are half-open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Neighbours that forbid a whole-word match: letters, decimal digits and the underscore.
WORD_CHAR = r"[\p{L}\p{Nd}_]"
MASK = "█"
SPANS = "array<struct<start:int,length:int,text:string>>"
#: Numbers that running() folds the slow way.
CHUNK = 128


def quote(text: str) -> str:
    """A regular expression that matches the text itself, in Java's dialect."""
    return "".join(c if c.isalnum() or c in " _" or ord(c) > 127 else "\\" + c for c in text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Of an array of numbers from 0 up: each with all before it, added or the greatest, as join does.

    Chunks are folded first and then carried on, so that a long array does not cost its square.
    """
    zero = F.lit(0)

    def fold(v: Column) -> Column:
        """Each with all before it, the slow way."""
        return F.transform(v, lambda x, i: F.aggregate(F.slice(v, 1, i), x, join))

    def carried(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), zero))
        return let(let(totals, fold), lambda upto: F.flatten(F.transform(parts, lambda p, c: let(F.coalesce(F.get(upto, c - 1), zero), lambda b: F.transform(p, lambda x: join(x, b))))))

    def chunked(v: Column) -> Column:
        numbers = F.sequence(zero, F.floor(F.greatest(F.size(v) - 1, zero) / CHUNK).cast("int"))
        return let(F.transform(numbers, lambda c: let(F.slice(v, c * CHUNK + 1, F.lit(CHUNK)), fold)), carried)

    return let(values, chunked)


def pattern_spans(text: Column, pattern: str, group: int = 0, consumed: int | None = None) -> Column:
    """array<struct<start,length,text>> of the matches of a pattern, those of nothing left out.

    The pieces between matches and the matches themselves give all offsets. group: which part of a match is the
    span, from the start of the match on; consumed: characters that every match takes, if that is not this part.
    """
    length = lambda h: F.length(h) if consumed is None else F.lit(consumed)

    def placed(hits: Column, pieces: Column) -> Column:
        gaps = F.transform(pieces, lambda p: F.length(p))
        # A match of nothing at the very start has no piece before it.
        gaps = F.when(F.size(hits) == F.size(pieces), F.concat(F.array(F.lit(0)), gaps)).otherwise(gaps)
        ends = running(F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: g + length(h)), lambda a, b: a + b)
        spans = F.zip_with(hits, ends, lambda h, e: F.struct((e - length(h)).alias("start"), F.length(h).alias("length"), h.alias("text")))
        return F.filter(spans, lambda s: s["length"] > 0)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda hits: let(F.split(text, pattern, -1), lambda pieces: placed(hits, pieces)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def literal_spans(text: Column, needle: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """All places of a needle, overlapping ones too: each match takes one character and looks ahead at the needle."""
    needle = needle.strip()
    if not needle:
        return F.array().cast(SPANS)
    before, after = (f"(?<!{WORD_CHAR})", f"(?!{WORD_CHAR})") if whole_word else ("", "")
    return pattern_spans(text, f"{'' if case_sensitive else '(?iu)'}{before}(?=({quote(needle)}){after})(?s:.)", 1, 1)


def wrapped(pattern: str, case_sensitive: bool = False, whole_word: bool = False) -> str:
    """A user's pattern as Java runs it: classes and cases are those of Unicode."""
    return ("(?U)" if case_sensitive else "(?iU)") + (rf"(?<!\w)(?:{pattern})(?!\w)" if whole_word else pattern)


def regex_spans(text: Column, pattern: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """Matches of a user's pattern, but for those of nothing."""
    return pattern_spans(text, wrapped(pattern, case_sensitive, whole_word))


def ordered(spans: Column) -> Column:
    """By start, the longer first, then by rule."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["length"]).alias("shorter"), s["rule_id"].alias("rule_id"), s["text"].alias("text")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["rule_id"].alias("rule_id"), s["start"].alias("start"), (-s["shorter"]).alias("length"), s["text"].alias("text")))


def merged(spans: Column) -> Column:
    """array<struct<start,length>>: the union of spans; those that touch become one."""
    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), (s["start"] + s["length"]).cast("int").alias("end"))))

    def union(s: Column, reach: Column) -> Column:
        """reach: how far each span and those before it go. A span beyond that begins a part."""
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] > F.get(reach, i - 1)))
        part = lambda begin, end: F.struct(begin.alias("start"), (end - begin).alias("length"))
        return let(firsts, lambda f: F.transform(f, lambda i, k: part(F.get(s, i)["start"], F.get(reach, F.coalesce(F.get(f, k + 1), F.size(s)) - 1))))

    def whole(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        return F.when(F.size(s) == 0, F.array().cast("array<struct<start:int,length:int>>")).otherwise(let(reach, lambda r: union(s, r)))

    return let(plain, whole)


def pieces(text: Column, union: Column) -> Column:
    """array<struct<hit,text>>: the text cut at merged spans, plain and hit parts in turn, none of them empty."""

    def part(hit: bool, start: Column, length: Column) -> Column:
        return F.struct(F.lit(hit).alias("hit"), F.substring(text, start + 1, length).alias("text"))

    def cut(u: Column) -> Column:
        end = lambda k: F.coalesce(F.get(u, k)["start"] + F.get(u, k)["length"], F.lit(0))
        pairs = F.transform(u, lambda s, k: F.array(part(False, end(k - 1), s["start"] - end(k - 1)), part(True, s["start"], s["length"])))
        return F.filter(F.concat(F.flatten(pairs), F.array(part(False, end(F.size(u) - 1), F.length(text)))), lambda p: p["text"] != "")

    return let(union, cut)


def masked(text: Column, union: Column) -> Column:
    """The text with every character of the merged spans covered, but for spaces, tabs and line ends."""
    shown = F.transform(pieces(text, union), lambda p: F.when(p["hit"], F.regexp_replace(p["text"], r"[^\n\r \t]", MASK)).otherwise(p["text"]))
    return F.array_join(shown, "")


def lines_of_pieces(text: Column, union: Column) -> Column:
    """array<array<struct<hit,text>>>: the pieces of each line, for highlighting; line ends belong to no piece."""
    cut = F.transform(pieces(F.replace(text, F.lit("\r\n"), F.lit("\n")), union), lambda p: F.transform(F.split(p["text"], "\n", -1), lambda t, i: F.struct((i > 0).alias("starts"), p["hit"].alias("hit"), t.alias("text"))))

    def lines(parts: Column, firsts: Column) -> Column:
        """firsts: where each line begins among the parts."""
        plain = lambda p: F.struct(p["hit"].alias("hit"), p["text"].alias("text"))
        each = lambda i, k: F.slice(parts, i + 1, F.coalesce(F.get(firsts, k + 1), F.size(parts)) - i)
        return F.transform(firsts, lambda i, k: F.transform(F.filter(each(i, k), lambda p: p["text"] != ""), plain))

    def whole(parts: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: (i == 0) | F.get(parts, i)["starts"])
        return let(firsts, lambda f: lines(parts, f))

    return let(F.flatten(cut), whole)
