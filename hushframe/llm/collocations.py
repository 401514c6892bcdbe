"""Phrase collocations: n-grams of distinct pieces of text, weighted by how often a piece occurs, counted out of core bucket by bucket.

Pairs of words are counted first, by 64-bit keys. Phrases are counted, as text, only where all their pairs may be frequent: a
filter of pairs, of bounded size, leaves out most of the others. Equal keys of different pairs, and places that pairs share in
the filter, only let more through: whatever passes is counted exactly and then compared.
"""

from __future__ import annotations

import shutil
import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii, utf8

#: What ends a piece: the marks and line ends.
PIECE_ENDS = r"[.,;:!?\x0A-\x0D]"


@dataclass(frozen=True)
class Settings:
    """least: a phrase's occurrences; longest: its words; best: phrases reported per language.

    pending, pending_pairs: phrases and occurrences of pairs that a task keeps before it sends their sums on; memory: what a bucket's counting may use before it goes
    to disk; filter_bits: bits of the filter of pairs at most; salts: shares of the answers about single words.
    """

    least: int = 100
    longest: int = 5
    best: int = 2000
    pending: int = 200_000
    pending_pairs: int = 2_000_000
    memory: str = "128MB"
    filter_bits: int = 1 << 26
    salts: int = 16


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, n_words, n): distinct pieces, their words joined by one space, and how often each occurs."""
    text = F.regexp_replace(lower_ascii(F.coalesce("text", F.lit(""))), r"[ \t]+", " ")
    parts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, PIECE_ENDS)).alias("piece"))
    words = F.trim("piece")
    counted = parts.select("lang", words.alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("n"))
    spaces = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit("")))
    return counted.select("lang", "piece", (spaces + 1).cast("long").alias("n_words"), "n")


class _Hashes(dict):
    """63-bit hashes of a language's words, kept as they are met."""

    def __init__(self, lang: str) -> None:
        self.seed = xxhash.xxh3_64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word, self.seed) >> 1
        return found


#: Words whose hashes a task keeps; more are hashed anew.
_KNOWN = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class _Words:
    """The words of a batch of pieces side by side: their hashes, how many follow in the same piece, the piece's number and how often it occurs."""

    words: list[bytes]
    hashes: np.ndarray
    following: np.ndarray
    piece: np.ndarray
    often: np.ndarray
    langs: list[str]

    def pairs(self) -> np.ndarray:
        """A key for each word and the next one; those of a piece's last words mean nothing."""
        h = self.hashes.astype(np.uint64)
        mixed = (h[:-1] * _MIX) ^ h[1:]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
        return np.append((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(1), np.uint64(0)).astype(np.int64)


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    known: dict[str, _Hashes] = {}
    for batch in batches:
        langs, words, hashes, sizes = batch.column(0).to_pylist(), [], [], []
        for lang, text in zip(langs, utf8(batch.column(1)), strict=True):
            own = text.split(b" ")
            if lang not in known or len(known[lang]) > _KNOWN:
                known[lang] = _Hashes(lang)
            words += own
            hashes += map(known[lang].__getitem__, own)
            sizes.append(len(own))
        size = np.array(sizes, np.int64)
        piece = np.repeat(np.arange(len(size)), size)
        yield _Words(words, np.array(hashes, np.int64), np.cumsum(size)[piece] - 1 - np.arange(len(words)), piece, batch.column(2).to_numpy(), langs)


def _pair_sums(rows: DataFrame, pending: int) -> DataFrame:
    """(pair, n): keys of pairs of neighbouring words with sums of their occurrences, several for one key."""

    def summed(keys: list[np.ndarray], often: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.concatenate(keys), np.concatenate(often)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        sums = np.add.reduceat(n[order], first) if len(key) else n
        return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(sums)], names=["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, often, size = [], [], 0
        for w in _laid_out(batches):
            inside = w.following > 0
            keys.append(w.pairs()[inside])
            often.append(w.often[w.piece[inside]])
            size += len(keys[-1])
            if size > pending:
                yield summed(keys, often)
                keys, often, size = [], [], 0
        if keys:
            yield summed(keys, often)

    return rows.select("lang", "piece", "n").mapInArrow(run, "pair long, n long")


def _grams(rows: DataFrame, longest: int, pending: int, pair_filter: np.ndarray) -> DataFrame:
    """(lang, phrase, n): sums for words, and for phrases of up to longest words all of whose pairs are in the filter; several sums for one phrase."""
    shared = rows.sparkSession.sparkContext.broadcast(pair_filter)

    def flushed(sums: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in sums.items():
            phrases, n = list(counts), list(counts.values())
            for i in range(0, len(phrases), 20_000):
                part = pa.array(phrases[i : i + 20_000], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(n[i : i + 20_000], pa.int64())], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}
        bits = shared.value
        for w in _laid_out(batches):
            at = w.pairs() & (len(bits) * 8 - 1)
            good = (w.following > 0) & ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)
            # Pairs in the filter from each word on, without a gap.
            gaps = np.flatnonzero(np.append(good, False) == 0)
            ahead = gaps[np.searchsorted(gaps, np.arange(len(good)))] - np.arange(len(good))
            lang_of = {lang: i for i, lang in enumerate(dict.fromkeys(w.langs))}
            lang_at, once = np.array([lang_of[x] for x in w.langs], np.int64)[w.piece], (w.often == 1)[w.piece]
            for k in range(1, longest + 1):
                chosen = ahead >= k - 1
                for lang, i in lang_of.items():
                    counts = sums.setdefault(lang, Counter())
                    here = chosen & (lang_at == i)
                    single = np.flatnonzero(here & once).tolist()
                    counts.update([w.words[j] for j in single] if k == 1 else [b" ".join(w.words[j : j + k]) for j in single])
                    several = np.flatnonzero(here & ~once)
                    for j, n in zip(several.tolist(), w.often[w.piece[several]].tolist(), strict=True):
                        counts[b" ".join(w.words[j : j + k])] += n
            if sum(map(len, sums.values())) > pending:
                yield from flushed(sums)
                sums = {}
        yield from flushed(sums)

    return rows.select("lang", "piece", "n").mapInArrow(run, "lang string, phrase string, n long")


def _counted(rows: DataFrame, least: int, memory: str) -> DataFrame:
    """rows (keys..., n) summed by their keys, if the sum is least or more. Each task sums its bucket of keys in DuckDB, which
    goes to a scratch folder of the task, gone at its end, where the sums outgrow the memory."""
    keys = rows.columns[:-1]
    sql = f"SELECT {', '.join(keys)}, sum(n)::BIGINT AS n FROM incoming GROUP BY {', '.join(keys)} HAVING sum(n) >= {least:d}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def stream() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        incoming = pa.RecordBatchReader.from_batches(first.schema, stream())  # noqa: F841  named in the SQL
        scratch = tempfile.mkdtemp(prefix="grams-")
        try:
            with duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": scratch, "preserve_insertion_order": False}) as con:
                yield from con.sql(sql).to_arrow_reader(20_000)
        finally:
            shutil.rmtree(scratch, ignore_errors=True)

    return rows.repartition(*keys).mapInArrow(run, rows.schema)


def _pair_filter(pairs: DataFrame, most_bits: int) -> np.ndarray:
    """Bytes with a bit at the place of each pair: some 16 bits for each, most_bits (a power of two) at most. Only words of 32 bits that are not 0 come to the driver."""
    bits, count = 1 << 16, pairs.count()
    while bits < most_bits and bits < 16 * count:
        bits *= 2
    place = F.col("pair").bitwiseAND(bits - 1)
    bit = F.expr("shiftleft(1L, cast(pair & 31 AS int))")
    parts = pairs.groupBy(F.shiftright(place, 5).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(bits // 32, np.dtype("<u4"))
    words[parts["at"].to_numpy()] = parts["bits"].to_numpy().astype(np.uint32)
    return words.view(np.uint8)


def phrase_counts(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(lang, phrase, n) of all phrases of up to longest words with least occurrences or more, and (lang, total): all word occurrences."""
    split = cut(pieces(docs), "pieces")
    totals = split.groupBy("lang").agg(F.sum(F.col("n_words") * F.col("n")).alias("total"))
    pairs = cut(_counted(_pair_sums(split.where("n_words > 1"), settings.pending_pairs), settings.least, settings.memory), "pairs")
    known = _pair_filter(pairs, settings.filter_bits)
    return cut(_counted(_grams(split, settings.longest, settings.pending, known), settings.least, settings.memory), "grams"), totals


def _stretch(words: Column, first: int, n: int) -> Column:
    return F.array_join(F.slice(words, first + 1, n), " ")


def scored(counts: DataFrame, totals: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(lang, phrase, k, a, l, r, n, score) of each phrase of two words or more: its lowest cut, behind k words.

    Each cut asks for the counts of its two parts; questions and counts meet by a shuffle on the part. Answers about single
    words, which many phrases may ask for, are dealt to several tasks.
    """
    many = counts.withColumnRenamed("n", "a").where(F.contains("phrase", F.lit(" "))).withColumn("words", F.split("phrase", " "))
    size, cuts = F.size("words"), []
    for k in range(1, settings.longest):
        parts = [(F.lit(True), _stretch(F.col("words"), 0, k)), (F.lit(False), F.array_join(F.slice("words", k + 1, settings.longest), " "))]
        cuts += [F.when(size > k, F.struct(F.lit(k).alias("k"), left.alias("left"), part.alias("part"))) for left, part in parts]
    asked = many.select("lang", "phrase", "a", F.explode(F.filter(F.array(*cuts), lambda c: c.isNotNull())).alias("c")).select("lang", "phrase", "a", "c.*")
    single = ~F.contains("part", F.lit(" "))
    asked = asked.withColumn("salt", F.when(single, F.pmod(F.xxhash64("phrase"), F.lit(settings.salts))).otherwise(0).cast("int"))
    last = F.when(single, settings.salts - 1).otherwise(0)
    answers = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")).withColumn("salt", F.explode(F.sequence(F.lit(0), last)))
    met = asked.join(answers, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    whole = met.join(totals.withColumnRenamed("total", "n"), "lang")
    exact = F.expr("cast((cast(a as decimal(18,0)) * cast(1000 as decimal(4,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)")
    best = F.min(F.struct(exact.alias("score"), "k", "l", "r", "n")).alias("b")
    return whole.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "b.k", "a", "b.l", "b.r", "b.n", "b.score")


def without_contained(candidates: DataFrame, longest: int = 5) -> DataFrame:
    """candidates (lang, phrase, a, ...) that lie in no longer candidate as frequent as they are."""
    words = F.split("phrase", " ")
    inner = [(i, n) for n in range(2, longest) for i in range(longest - n + 1)]
    inside = F.array(*[F.when((F.size("words") > n) & (F.size("words") >= i + n), _stretch(F.col("words"), i, n)) for i, n in inner])
    held = candidates.select("lang", words.alias("words"), "a").select("lang", F.explode(F.array_compact(inside)).alias("phrase"), "a")
    most = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(most, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")


def top_phrases(kept: DataFrame, best: int, salts: int = 16) -> DataFrame:
    """The best of each language with their rank: first of each share of a language, then of those that are left."""
    share = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    near = kept.withColumn("share", share)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= best)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best).drop("share")


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases.

    docs: text and lang; other columns are ignored. A null lang is und; null and empty texts have no pieces; repeated rows count
    each; ties in score and occurrences go by the phrase's bytes. No rows, or no phrase frequent enough: no rows.
    """
    counts, totals = phrase_counts(docs, settings)
    candidates = cut(scored(counts, totals, settings), "phrases")
    return top_phrases(without_contained(candidates, settings.longest), settings.best, settings.salts).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
