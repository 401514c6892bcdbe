"""Removal of passages that repeat, by super-k-mers.

A window is 35 consecutive words. Its minimiser is the least hash among its runs of 8 words, and
consecutive windows with the same minimiser form a super-k-mer. Equal windows have equal minimisers, so:
minimisers are counted first, and only super-k-mers whose minimiser occurs again travel, each as one packed
string, to the bucket of their minimiser. There the windows are sorted and counted exactly. A minimiser
with many super-k-mers has many buckets: what a bucket holds twice is settled there, and a window that it holds
once is looked for in the others by its digest.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, utf8

WINDOW, MER = 35, 8
#: Windows of one super-k-mer at most; a longer run of windows is packed in several.
LONGEST = 256
#: Super-k-mers of one minimiser that meet in one bucket, and those that one call sorts, about.
BUCKET, CALL_ROWS = 1024, 2000
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def minimisers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The minimiser of each window, and the hash of each run of MER words."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    one = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)
    mers = np.zeros(len(words) - MER + 1, np.uint64)
    for j in range(MER):
        mers = mers * _K1 + one[j : j + len(mers)]
    mers = (mers ^ (mers >> np.uint64(29))) * _K2
    mers ^= mers >> np.uint64(32)
    least, width, want = mers, 1, WINDOW - MER + 1
    while width < want:  # the least of width runs, then of twice as many, at most of those in a window
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least, mers


def super_k_mers(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window of each super-k-mer, and the one after its last."""
    change = np.r_[True, least[1:] != least[:-1]]
    since = np.arange(len(least))
    since = since - np.maximum.accumulate(np.where(change, since, 0))
    first = np.flatnonzero(since % LONGEST == 0)
    return first, np.r_[first[1:], len(least)]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, values, weights = [], [], [], []
        for text in utf8(batch.column(2)):
            words = text.split()
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            least, mers = minimisers(words)
            if len(least):
                found, runs = np.unique(least[super_k_mers(least)[0]], return_counts=True)
                known, often = np.unique(mers, return_counts=True)
                # A minimiser that occurs again within the document may repeat within one super-k-mer.
                weight = np.maximum(runs, np.minimum(2, often[np.searchsorted(known, found)]))
                values.append(found.view(np.int64))
                weights.append(weight.astype(np.int32))
            else:
                values.append([])
                weights.append([])
        columns = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(values, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "n_words", "sha256", "v", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of the flagged minimisers: columns row_key, text, v, n in."""
    for batch in batches:
        out: dict[str, list] = {"v": [], "salt": [], "salted": [], "row_key": [], "at": [], "packed": []}
        for key, text, flags, sizes in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2), batch.column(3), strict=True):
            buckets = dict(zip(flags.values.to_pylist(), (-(-n // BUCKET) for n in sizes.values.to_pylist()), strict=True))
            words = text.split()
            least, _ = minimisers(words)
            first, after = super_k_mers(least)
            for v, a, b in zip(least[first].view(np.int64).tolist(), first.tolist(), after.tolist(), strict=True):
                if v in buckets:
                    out["v"].append(v)
                    out["salt"].append(xxhash.xxh32_intdigest(key, a) % buckets[v])
                    out["salted"].append(buckets[v] > 1)
                    out["row_key"].append(key)
                    out["at"].append(a)
                    out["packed"].append(b" ".join(words[a : b + WINDOW - 1]))
            if len(out["v"]) > 20_000:
                yield _batch(out)
                out = {name: [] for name in out}
        yield _batch(out)


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))


_SPAN = pa.struct([("row_key", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])


def _counted(data: pa.Table) -> pa.Table:
    """Spans of repeated windows of a call's buckets. Windows of salted minimisers come with their digest, and with
    their span where the bucket has them once; so no digest has more spans than the minimiser has buckets."""
    keys, at, salted = (data.column(c).to_pylist() for c in ("row_key", "at", "salted"))
    windows: list[tuple[bytes, int, int]] = []
    for i, packed in enumerate(data.column("packed").to_pylist()):
        ends = [-1]
        while (e := packed.find(b" ", ends[-1] + 1)) >= 0:
            ends.append(e)
        ends.append(len(packed))
        windows += [(packed[ends[j] + 1 : ends[j + WINDOW]], i, at[i] + j) for j in range(len(ends) - WINDOW)]
    windows.sort()
    digests, counts, spans = [], [], []
    repeated: dict[int, list[int]] = defaultdict(list)
    for window, same in groupby(windows, itemgetter(0)):
        same = list(same)
        if salted[same[0][1]]:
            digests.append(hashlib.blake2b(window, digest_size=16).digest())
            counts.append(min(2, len(same)))
            spans.append([(keys[i], w, w + WINDOW) for _, i, w in same] if len(same) == 1 else [])
        if len(same) > 1:
            for _, i, w in same:
                repeated[i].append(w)
    for i, found in repeated.items():
        found.sort()
        digests.append(None)
        counts.append(0)
        spans.append([(keys[i], lo, hi) for lo, hi in _joined([(w, w + WINDOW) for w in found])])
    spans = [[{"row_key": k, "lo": lo, "hi": hi} for k, lo, hi in s] for s in spans]
    return pa.table([pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(_SPAN))], ["digest", "n", "spans"])


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted half-open spans, overlapping and touching ones together."""
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, found) of docs (doc_id, text).

    summaries: doc_id, row_key, n_words and the sha256 of all words, one row for each row of docs; found: row_key, text and the
    half-open spans of words that lie in windows found elsewhere, one row for each distinct row with any.
    """
    texts = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    summaries = cut(texts.mapInArrow(_summaries, f"doc_id {kind}, row_key binary, n_words long, sha256 string, v array<long>, n array<int>"), "minimisers")
    # 64 bits tell documents apart here: a clash only lets a document send more than it needs.
    listed = summaries.select(F.xxhash64("row_key").alias("doc"), F.explode(F.arrays_zip("v", "n")).alias("x")).select("doc", "x.v", "x.n")
    again = cut(listed.groupBy("v").agg(F.sum("n").alias("n")).where("n > 1"), "again")
    total = again.agg(F.sum("n")).first()[0] or 0
    flags = listed.select("doc", "v").join(again, "v").groupBy("doc").agg(F.collect_list("v").alias("v"), F.collect_list("n").alias("n"))
    flagged = cut(texts.select("row_key", "text").join(flags, F.xxhash64("row_key") == flags["doc"]).select("row_key", "text", "v", "n"), "flagged")
    packed = flagged.mapInArrow(_packed, "v long, salt int, salted boolean, row_key binary, at int, packed binary")
    calls = max(64, -(-total // CALL_ROWS))
    placed = packed.withColumn("call", F.pmod(F.xxhash64("v", "salt"), F.lit(calls))).drop("v", "salt")
    counted = cut(placed.groupBy("call").applyInArrow(_counted, "digest binary, n long, spans array<struct<row_key: binary, lo: int, hi: int>>"), "counted")
    parts = counted.where("digest is not null")
    twice = parts.groupBy("digest").agg(F.sum("n").alias("times")).where("times > 1").select("digest")
    spans = counted.where("digest is null").select("spans").union(parts.where("n = 1").join(twice, "digest").select("spans"))
    by_row = spans.select(F.explode("spans").alias("s")).groupBy(F.col("s.row_key").alias("found_key")).agg(F.array_sort(F.collect_set(F.struct("s.lo", "s.hi"))).alias("spans"))
    found = flagged.dropDuplicates(["row_key"]).join(by_row, F.col("row_key") == F.col("found_key")).select("row_key", "text", "spans")
    return summaries.select("doc_id", "row_key", "n_words", "sha256"), found


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept = [], []
        for text, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words, left, at, gone = text.split(), [], 0, 0
            for lo, hi in _joined([(s["lo"], s["hi"]) for s in spans]):
                left += words[at:lo]
                at, gone = hi, gone + hi - lo
            removed.append(gone)
            kept.append(b" ".join(left + words[at:]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["kept_key", "n_removed", "kept"])


def _outcomes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    summaries, found = repeated_spans(docs)
    return summaries, found.mapInArrow(_kept, "kept_key binary, n_removed long, kept string")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): one row for each row of docs (doc_id, text).

    kept_sha256 is that of the kept words joined by spaces. Null and empty texts have no words; null ids keep
    their row; rows that repeat an id and text repeat each other's windows; an empty table gives no row.
    Other columns are not read.
    """
    summaries, kept = _outcomes(docs)
    digests = kept.select("kept_key", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    joined = summaries.join(digests, summaries["row_key"] == digests["kept_key"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the kept words, joined by spaces, as text where words were removed; all rows and columns stay."""
    _, kept = _outcomes(docs)
    joined = docs.join(kept, row_key(docs["doc_id"], docs["text"]) == kept["kept_key"], "left")
    return joined.select(*[F.coalesce(kept["kept"], docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns])
