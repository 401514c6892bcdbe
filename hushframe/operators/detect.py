"""Matches, redaction spans, masked texts and counts of rules over a table of texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import masked, merged, ordered
from .rules import Rule, active, rule_spans
from .sequences import interval_union

_MATCHES = "array<struct<rule_id:string,start:int,length:int,text:string>>"


def with_matches(df: DataFrame, text: str, rules: Iterable[Rule]) -> DataFrame:
    """df with column matches: all matches of all valid, enabled rules, by start, the longer first."""
    every = []
    for rule in active(rules):
        spans = rule_spans(F.coalesce(F.col(text), F.lit("")), rule)
        every.append(F.transform(spans, _named(rule.id)))
    return df.withColumn("matches", ordered(F.concat(*every)) if every else F.array().cast(_MATCHES))


def _named(rule_id: str):
    return lambda s: F.struct(F.lit(rule_id).alias("rule_id"), s["start"].alias("start"), s["length"].alias("length"), s["text"].alias("text"))


def find_matches(df: DataFrame, text: str, rules: Iterable[Rule], keys: list[str]) -> DataFrame:
    """(keys, rule_id, start, length, text): a row for each match."""
    found = with_matches(df.select(*keys, F.col(text)), text, rules)
    return found.select(*keys, F.explode("matches").alias("m")).select(*keys, "m.*")


def merge_spans(df: DataFrame, text: str, rules: Iterable[Rule], keys: list[str]) -> DataFrame:
    """(keys, start, length): the union of all matches of a text."""
    found = with_matches(df.select(*keys, F.col(text)), text, rules).withColumn("m", F.explode(merged(F.col("matches"))))
    return found.select(*keys, "m.start", "m.length")


def mask(df: DataFrame, text: str, rules: Iterable[Rule]) -> DataFrame:
    """df with column masked: every match covered."""
    return with_matches(df, text, rules).withColumn("masked", masked(F.coalesce(F.col(text), F.lit("")), merged(F.col("matches")))).drop("matches")


def rule_counts(matches: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """(rule_id, label, n): matches of each rule; the label says nothing of what was found."""
    names = matches.sparkSession.createDataFrame([(r.id, r.label if r.label.strip() else "Unnamed rule") for r in rules], "rule_id string, label string")
    return matches.groupBy("rule_id").agg(F.count("*").alias("n")).join(F.broadcast(names), "rule_id").select("rule_id", "label", "n")


def summary(counts: DataFrame) -> DataFrame:
    """counts with a sentence on n."""
    text = F.when(F.col("n") == 0, "No matches").when(F.col("n") == 1, "1 match").otherwise(F.concat(F.col("n").cast("string"), F.lit(" matches")))
    return counts.withColumn("summary", text)


def merge_rows(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, length) from rows of spans: islands of spans that overlap or touch."""
    spans = matches.select(F.struct(*keys).alias("key"), F.col("start").alias("lo"), (F.col("start") + F.col("length")).alias("hi"))
    return interval_union(spans, "key", "lo", "hi").select("key.*", F.col("lo").alias("start"), (F.col("hi") - F.col("lo")).alias("length"))
