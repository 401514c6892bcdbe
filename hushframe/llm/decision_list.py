"""Quality rules learnt as a decision list, with DataFrame operations only.

Text statistics of every document are computed in place, row by row. Sequential covering then grows
conjunctions of thresholds that find poor documents: each step counts good and poor documents by
statistic and bin in one aggregation, takes the condition with the largest information gain, and a rule
is pruned on labelled documents that did not grow it. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, word_array

WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20
SYMBOLS = "#*$%&|<>"
#: What rules may test; each is a number for every text.
TESTED = ("n_words", "word_length", "symbols_per_word", "repeated_share", "dup_line_share", "upper_share", "digit_share", "distinct_share", "mark_share")


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    edge: float

    def column(self) -> Column:
        return F.col(self.name) > self.edge if self.above else F.col(self.name) <= self.edge


@dataclass(frozen=True)
class Settings:
    bins: int = 16
    rules: int = 8
    conditions: int = 3
    #: Least share of poor documents among those that a rule finds, on documents that did not grow it.
    precision: float = 0.8
    least_found: int = 3


def statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the base statistics and the tested ones; null text counts as no words.

    A window of words counts as found again if the 64-bit hashes of its words in order are equal.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("w", word_array(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - WINDOW + 1), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
        (F.length("text") - F.length(F.translate("text", "0123456789", ""))).alias("n_digits"),
        (F.length("text") - F.length(F.translate("text", "!?=_~^@+{}[]\\/", ""))).alias("n_marks"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        lines.alias("lines"),
        F.when(F.size("w") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # Only texts with some window twice are sorted; equal hashes then stand side by side.
    again = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("sorted", F.when(again, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    beside = F.filter("sorted", lambda s, k: (F.get("sorted", k - 1)["x"] == s["x"]) | (F.get("sorted", k + 1)["x"] == s["x"]))
    d = d.withColumn("at", F.array_sort(F.transform(beside, lambda s: s["i"])))
    new_words = F.transform("at", lambda p, k: F.coalesce(F.least(F.get("at", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    d = d.select(
        "*",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(new_words, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
    )
    words = F.greatest("n_words", F.lit(1)).cast("double")
    chars = F.greatest("word_chars", F.lit(1)).cast("double")
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") / words).alias("word_length"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_repeat_words") / words).alias("repeated_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_upper") / chars).alias("upper_share"),
        (F.col("n_digits") / chars).alias("digit_share"),
        (F.col("n_distinct") / words).alias("distinct_share"),
        (F.col("n_marks") / words).alias("mark_share"),
    )


def _all(rule: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def _bin(name: str, edges: list[float]) -> Column:
    """How many of the edges lie below the statistic."""
    return reduce(lambda a, b: a + b, (F.when(F.col(name) > e, 1).otherwise(0) for e in edges))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def _grow(rows: DataFrame, edges: dict[str, list[float]], settings: Settings) -> list[Condition]:
    """One rule for the rows (poor, TESTED columns): conditions are added while they gain."""
    rule: list[Condition] = []
    while len(rule) < settings.conditions:
        bins = [F.struct(F.lit(name).alias("name"), _bin(name, e).alias("bin")) for name, e in edges.items() if e]
        if not bins:  # no labels, so no edges
            break
        counted = rows.where(_all(rule)).select("poor", F.explode(F.array(*bins)).alias("b")).groupBy("b.name", "b.bin").agg(F.sum("poor").alias("p"), F.count("*").alias("n"))
        table: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counted.collect():  # a row for each statistic and bin
            table.setdefault(r["name"], {})[r["bin"]] = (r["p"], r["n"] - r["p"])
        if not table:
            break
        p0, n0 = (sum(x[i] for x in next(iter(table.values())).values()) for i in (0, 1))
        if not p0 or not n0:
            break
        best, most = None, 0.0
        for name in sorted(table):
            p = n = 0
            for b, edge in enumerate(edges[name]):
                p, n = (old + new for old, new in zip((p, n), table[name].get(b, (0, 0)), strict=True))
                for above, got in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    if got[0] >= settings.least_found and (g := _gain(*got, p0, n0)) > most:
                        best, most = Condition(name, above, edge), g
        if best is None:
            break
        rule.append(best)
    return rule


def _pruned(rows: DataFrame, rule: list[Condition]) -> tuple[list[Condition], int, int]:
    """The beginning of the rule with the best (poor - good) / found, and what it finds of either."""
    sums = [F.sum(F.when(_all(rule[:k]), v).otherwise(0)).alias(f"{s}{k}") for k in range(1, len(rule) + 1) for s, v in (("p", F.col("poor")), ("n", 1 - F.col("poor")))]
    got = rows.agg(*sums).first()
    worth = {k: (got[f"p{k}"] or 0, got[f"n{k}"] or 0) for k in range(1, len(rule) + 1)}
    k = max(worth, key=lambda k: ((worth[k][0] - worth[k][1]) / max(1, sum(worth[k])), -k))
    return rule[:k], *worth[k]


def learn(stats: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> list[list[Condition]]:
    """Ordered rules that find documents labelled poor (quality 0); no rule if there are no labels of both kinds."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = cut(stats.join(known, "doc_id").select((1 - F.col("quality")).cast("long").alias("poor"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part"), *TESTED), "labelled")
    # Approximate quantiles of fixed accuracy: a bounded number of edges.
    cuts = rows.approxQuantile(list(TESTED), [i / settings.bins for i in range(1, settings.bins)], 0.005)
    edges = {name: sorted(set(c)) for name, c in zip(TESTED, cuts, strict=True)}
    rules: list[list[Condition]] = []
    rest = rows
    while len(rules) < settings.rules:
        rule = _grow(rest.where("part > 0"), edges, settings)
        if not rule:
            break
        rule, p, n = _pruned(rest.where("part = 0"), rule)
        if p < settings.precision * (p + n) or not p:
            break
        rules.append(rule)
        rest = rest.where(~_all(rule))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that finds a row, from 1; null if none does."""
    case = reduce(lambda c, kr: c.when(_all(kr[1]), kr[0]), enumerate(rules, 1), F)
    return case if rules else F.lit(None).cast("int")


def apply_rules(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Base statistics, base_failed, rule (the first that finds the row) and kept: one row for each row of docs.

    Null or empty texts have no words and fail the base; null ids are judged but never learnt from; repeated
    rows get equal verdicts; an empty table gives no row. Other columns of docs are not read.
    """
    stats = cut(statistics(docs), "statistics")
    return stats.withColumn("rule", verdict(learn(stats, labels, settings))).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
