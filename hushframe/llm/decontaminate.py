"""Benchmark decontamination with DataFrame operations only.

The 64-bit hashes of the benchmark's word windows form a hash set of buckets, about one hash in each, which every
task gets as a constant. The windows of a training text whose hash is in the set become rows; a join on the
window's words themselves verifies them, and the verified ones mark words, spans or whole documents. A benchmark with more
windows than one set may hold has several sets, which the texts meet one after the other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, if_few, lower_ascii, row_key

WINDOW = 10
#: Windows of one hash set: some 80 bytes each, so that an executor holds 20 MB of them at most.
SET_WINDOWS = 1 << 18
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and characters beyond ASCII; an empty array for null."""
    spaced = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), _NOT_WORD, " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def _windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, k, window): every window of every item; an item of fewer words, but not none, is one window."""
    items = benchmark.select("item_id", normal_words(F.col("text")).alias("w")).where("size(w) > 0")
    k = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - k + 1))
    cuts = items.select("item_id", "w", k.alias("k"), starts.alias("i"))
    return cuts.select("item_id", "k", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("window")).distinct()


def _bucket(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def _hash_set(hashes: DataFrame, buckets: int) -> Column:
    """array<array<bigint>>: the hashes (column h) of each bucket, by their lower bits, as a constant of the plan.

    The driver holds the hashes of one set at most. A text that the optimizer reads once stands for them.
    """
    found = np.sort(hashes.toArrow().column("h").to_numpy().astype(np.int64))
    found = found[np.argsort(found & (buckets - 1), kind="stable")]
    parts = np.split(found, np.searchsorted(found & (buckets - 1), np.arange(1, buckets)))
    return F.from_json(F.lit("[" + ",".join(str(p.tolist()) for p in parts) + "]"), "array<array<bigint>>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _hits_of_set(texts: DataFrame, hashes: DataFrame, count: int, lengths: list[int]) -> DataFrame:
    """(row_key, at, k, window) of the windows of texts (row_key, w) whose hash is among hashes (h), of which there are count."""
    buckets = 1 << max(0, count - 1).bit_length()
    inside = _hash_set(hashes, buckets)

    def starts(k: int, hw: Column, held: Column) -> Column:
        """Where the windows of k words begin that the set holds."""
        at = F.sequence(F.lit(1), F.size(hw) - k + 1)
        known = lambda h: F.array_contains(F.get(held, _bucket(h, buckets)), h)
        found = let(F.transform(at, lambda i: F.xxhash64(F.slice(hw, i, k))), lambda h: F.filter(at, lambda i: known(F.get(h, i - 1))))
        cuts = F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(k).alias("k"), F.array_join(F.slice("w", i, k), " ").alias("window")))
        return F.when(F.size(hw) >= k, cuts)

    every = lambda held: let(_hashed(F.col("w")), lambda hw: F.flatten(F.array_compact(F.array(*[starts(k, hw, held) for k in lengths]))))
    return texts.select("row_key", F.explode(let(inside, every)).alias("c")).select("row_key", "c.*")


def find_hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row_key, n_words) for each row of docs, and (row_key, at, k, item_id) for each occurrence of a benchmark window.

    at counts words from 1. Rows that repeat id and text repeat in the first result and share the occurrences.
    """
    windows = cut(_windows(benchmark), "windows")
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most WINDOW of them
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), normal_words(F.col("text")).alias("w"))
    counted = texts.select("row_key", F.size("w").cast("long").alias("n_words"))
    if not lengths:
        return counted, texts.sparkSession.createDataFrame([], "row_key binary, at int, k int, item_id " + benchmark.schema["item_id"].dataType.simpleString())
    hashes = cut(windows.select(F.xxhash64(_hashed(F.split("window", " "))).alias("h")).distinct(), "hashes")
    count = hashes.count()
    sets = -(-count // SET_WINDOWS)
    share = lambda i: hashes.where(F.pmod(F.shiftrightunsigned("h", 40), F.lit(sets)) == i) if sets > 1 else hashes
    likely = reduce(DataFrame.unionByName, [_hits_of_set(texts, share(i), -(-count // sets), lengths) for i in range(sets)])
    # By the words themselves; equal hashes of other words end here.
    return counted, likely.join(if_few(windows, windows.count()), ["k", "window"]).select("row_key", "at", "k", "item_id")


def _covered(spans: Column) -> Column:
    """Words covered by spans (at, end) that are sorted: the sum of what each adds beyond those before it."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["at"] - 1))).alias("n"))
    return F.aggregate(spans, start, step, lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated): one row for each row of docs.

    items: the sorted ids, as strings, of the items with occurring windows; spans: (at, end) in words, from 1, both
    included. Null and empty texts have no words and are clean; null ids keep their row; empty tables give no row or
    no hit; items without an id count as hits but are not listed. Other columns are not read.
    """
    counted, hits = find_hits(docs, benchmark)
    span = F.struct("at", (F.col("at") + F.col("k") - 1).alias("end"))
    by_row = hits.groupBy("row_key").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    by_row = by_row.withColumn("n_hit", _covered(F.col("spans"))).withColumnRenamed("row_key", "hit_key")
    ids = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.size(normal_words(F.col("text"))).cast("long").alias("n_words"))
    joined = ids.join(by_row, ids["row_key"] == by_row["hit_key"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "row_key", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark window; all columns and all other rows stay."""
    _, hits = find_hits(docs, benchmark)
    dirty = cut(hits.select(F.col("row_key").alias("__dirty_key")).distinct(), "dirty")
    return docs.join(if_few(dirty, dirty.count()), row_key(docs["doc_id"], docs["text"]) == dirty["__dirty_key"], "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text): normalised texts of docs without the words inside benchmark windows; null and empty texts come out empty."""
    found = contamination(docs, benchmark).select(F.col("row_key").alias("found_key"), "spans").dropDuplicates(["found_key"])
    words = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), normal_words(F.col("text")).alias("w"))
    joined = words.join(found, words["row_key"] == found["found_key"], "left")
    clean = F.filter("w", lambda w, i: ~F.coalesce(F.exists("spans", lambda s: (s["at"] <= i + 1) & (i + 1 <= s["end"])), F.lit(False)))
    return joined.select("doc_id", F.array_join(clean, " ").alias("text"))
