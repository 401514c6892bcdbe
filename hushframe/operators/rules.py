"""Rules: what must stay private, as a small table that is compiled into column expressions."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.detectors import DETECTORS, RECOMMENDED, detector_spans
from ..functions.fuzzy import fuzzy_spans
from ..functions.spans import SPANS, literal_spans

LOG = logging.getLogger(__name__)
SCHEMA = "id string, label string, kind string, pattern string, built_in string, enabled boolean, case_sensitive boolean, whole_word boolean, fuzzy boolean, fuzzy_threshold int, is_auto_discovered boolean"


@dataclass(frozen=True)
class Rule:
    kind: str = "Text"  # Text, Regex, BuiltIn or AppWindow
    pattern: str = ""
    label: str = ""
    built_in: str = "Email"
    enabled: bool = True
    case_sensitive: bool = False
    whole_word: bool = False
    fuzzy: bool = False
    fuzzy_threshold: int = 85
    is_auto_discovered: bool = False
    id: str = field(default_factory=lambda: str(uuid4()))

    @property
    def display_name(self) -> str:
        return self.label if self.label.strip() else self.built_in if self.kind == "BuiltIn" else self.pattern


def validate(rule: Rule) -> str | None:
    """The first problem of a rule, or None."""
    if rule.kind == "BuiltIn":
        return None if rule.built_in in DETECTORS else "Unknown detector."
    if not rule.pattern.strip():
        return "The pattern is empty."
    if rule.kind == "AppWindow":
        return None if len(rule.pattern.strip()) >= 3 else "Give at least 3 characters."
    if rule.kind == "Regex":
        return patterns.problem(rule.pattern, rule.case_sensitive, rule.whole_word)
    if rule.kind == "Text" and rule.fuzzy and not 50 <= rule.fuzzy_threshold <= 100:
        return "The threshold must be from 50 to 100."
    return None


def normalised(rule: Rule) -> Rule:
    """A rule as it is saved: only the settings that its kind has."""
    text, app = rule.kind == "Text", rule.kind == "AppWindow"
    return replace(rule, label=rule.label.strip(), pattern="" if rule.kind == "BuiltIn" else rule.pattern, case_sensitive=rule.case_sensitive and not app, whole_word=rule.whole_word and not app, fuzzy=rule.fuzzy and text, fuzzy_threshold=min(100, max(50, rule.fuzzy_threshold)))


def refused(rules: Iterable[Rule]) -> list[tuple[Rule, str]]:
    """Rules that are on and cannot run, each with its problem."""
    return [(r, problem) for r in rules if r.enabled and (problem := validate(r)) is not None]


def active(rules: Iterable[Rule]) -> list[Rule]:
    """Rules that are on and can run. Those that cannot cost the others nothing; the log says which, without their patterns."""
    kept = list(rules)
    for rule, problem in refused(kept):
        LOG.warning("rule %s is left out: %s", rule.id, problem)
    return [r for r in kept if r.enabled and validate(r) is None]


def from_rows(df: DataFrame) -> list[Rule]:
    """Rules of a table with SCHEMA, which is small."""
    return [Rule(**{k: v for k, v in r.asDict().items() if v is not None}) for r in df.collect()]


def guarded_spans(text: Column, rule: Rule) -> Column:
    """A user's pattern with a time limit for each text; a text that takes longer has no match for this rule."""
    args = rule.pattern, rule.case_sensitive, rule.whole_word

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        pattern = patterns.compiled(*args)
        return texts.map(lambda t: [{"start": at, "length": len(hit), "text": hit} for at, hit in patterns.matches(pattern, t or "")])

    return run(text)


def rule_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start,length,text>> of one rule; window rules find nothing in text.

    Users' patterns all run in the engine that can be stopped, so that a rule means the same whatever it costs.
    """
    if rule.kind == "BuiltIn":
        return detector_spans(text, rule.built_in)
    if rule.kind == "Regex":
        return guarded_spans(text, rule)
    if rule.kind == "Text":
        return fuzzy_spans(text, rule.pattern, rule.fuzzy_threshold) if rule.fuzzy else literal_spans(text, rule.pattern, rule.case_sensitive, rule.whole_word)
    return F.array().cast(SPANS)


def described(rules: DataFrame) -> DataFrame:
    """Display name, hidden value and a one-line description of each rule."""
    name = F.when(F.trim("label") != "", F.col("label")).when(F.col("kind") == "BuiltIn", F.col("built_in")).otherwise(F.col("pattern"))
    options = F.concat_ws(", ", F.when(F.col("case_sensitive"), "case sensitive"), F.when(F.col("whole_word"), "whole word"), F.when(F.col("fuzzy"), F.concat(F.lit("fuzzy "), F.col("fuzzy_threshold"))))
    hidden = F.repeat(F.lit("•"), F.least(F.length("pattern"), F.lit(12)))
    return rules.select("id", name.alias("display_name"), "kind", hidden.alias("hidden"), options.alias("options"))


def discovered_rules(values: DataFrame) -> DataFrame:
    """Rules for discovered values (seq, category, value): trimmed, of 3 characters or more, first of each value."""
    from pyspark.sql import Window

    clean = values.withColumn("value", F.trim("value")).where(F.length("value") >= 3)
    first = F.row_number().over(Window.partitionBy(F.lower("value")).orderBy("seq"))
    kept = clean.withColumn("n", first).where("n = 1")
    fuzzy = (F.length("value") >= 5) & (F.col("category") != "Local IP")
    return kept.select("seq", "category", F.col("value").alias("pattern"), F.lit(True).alias("whole_word"), fuzzy.alias("fuzzy"), F.lit(85).alias("fuzzy_threshold"))


def uncovered(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Values that no rule has as its pattern yet, whatever the case."""
    have = rules.select(F.lower(F.trim("pattern")).alias("have")).distinct()
    return values.join(have, F.lower(F.trim("value")) == F.col("have"), "left_anti")


def missing_detectors(rules: DataFrame, by: str | None = None) -> DataFrame:
    """The recommended detectors that no rule uses; with by, (by, built_in) for each value of that column of rules, which may
    be many: those that a value has are counted in one pass and taken from the whole list."""
    wanted = F.array(*[F.lit(d) for d in RECOMMENDED])
    has = F.collect_set(F.when(F.col("kind") == "BuiltIn", F.col("built_in")))
    used = rules.groupBy(*([by] if by else [])).agg(has.alias("has"))
    return used.select(*([by] if by else []), F.explode(F.array_except(wanted, "has")).alias("built_in"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, state) of rules (id, signature): added, removed, changed or unchanged."""
    o, n = old.select("id", F.col("signature").alias("was")), new.select("id", F.col("signature").alias("now"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return o.join(n, "id", "full").select("id", state.alias("state"))
