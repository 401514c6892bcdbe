"""Scores of texts by an interpolated bigram model of the corpus.

Documents are dealt to blocks. Each block asks for the corpus counts of its distinct words and word pairs,
packed by ranges of their hashes; each range adds up what all blocks hold and answers in the order of the
question, so that a block can score its documents without one row for each token. The model mixes the
shares of the pair, of the word and of an unseen word; the weights depend on how often the context occurs and
are learnt by expectation-maximisation, each document being held out from the counts that predict it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import crc_fold, cut, row_key, utf8

FOLDS, HELD_OUT = 7, 2
#: Characters of a block, about.
BLOCK_CHARS = 3_000_000
CONTEXT_BUCKETS = 24
#: So many blocks' worth of keys, about, make a range: fewer and longer rows, of which there is one for each block and range.
RANGE_BLOCKS = 4
_END = xxhash.xxh64_intdigest(b"")
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Totals:
    tokens: int
    words: int


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the block, an end behind each text, and the number of tokens of each text."""
    known: dict[bytes, int] = {}
    hashed, sizes = [], []
    column = table.column("text").combine_chunks()
    for text in utf8(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column):
        words = text.lower().split()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        hashed.append(np.fromiter((known[w] for w in words), np.uint64, len(words)))
        hashed.append(np.array([_END], np.uint64))
        sizes.append(len(words) + 1)
    return np.concatenate(hashed), np.array(sizes)


def _pairs(tokens: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Keys of each token with the one before it (an end before the first): the range in the upper bits, then 48 bits, or what 64 leave."""
    before = np.r_[np.uint64(_END), tokens[:-1]]
    before[np.cumsum(sizes)[:-1]] = _END
    h = (before * _K1) ^ tokens
    h = (h ^ (h >> np.uint64(32))) * _K2
    h ^= h >> np.uint64(29)
    h *= _K1
    return h >> np.uint64(max(0, 16 - bits))


def _shift(kind: int, bits: int) -> int:
    """Bits of a key below its range."""
    return min(48, 64 - bits) if kind else 64 - bits


def _ranges(keys: np.ndarray, shift: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the ranges that occur, and where each begins (and the end)."""
    r = (keys >> np.uint64(shift)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    return r[start], np.r_[start, len(keys)]


def _pack(keys: np.ndarray, width: int) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<u8").ravel()


def _differences(keys: np.ndarray) -> np.ndarray:
    return np.r_[keys[:1], keys[1:] - keys[:-1]]


def _distinct(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sum of the weights of each, and where each key of the input stands among them."""
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, weight, len(found)).astype(np.int64), where


def _questions(bits: int):
    def ask(table: pa.Table) -> pa.Table:
        tokens, sizes = _tokens(table)
        train = np.repeat(table.column("train").to_numpy().astype(np.int64), sizes)
        block = table.column("block")[0].as_py()
        rows = []
        for kind, keys in enumerate((tokens, _pairs(tokens, sizes, bits))):
            found, counts, _ = _distinct(keys, train)
            ranges, start = _ranges(found, _shift(kind, bits), bits)
            for r, a, b in zip(ranges.tolist(), start[:-1].tolist(), start[1:].tolist(), strict=True):
                own = found[a:b] & np.uint64((1 << _shift(kind, bits)) - 1) if kind else found[a:b]
                rows.append((block, kind, r, _pack(_differences(own), 6 if kind else 8), counts[a:b].astype("<u4").tobytes()))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], ["block", "kind", "part", "keys", "counts"])

    return ask


def _answers(table: pa.Table) -> pa.Table:
    """Add up one range over all blocks; a last row without a block tells how many keys and tokens were counted."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    keys = [np.cumsum(_unpack(k, 6 if kind else 8), dtype=np.uint64) for k in table.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in table.column("counts").to_pylist()])
    found, total, where = _distinct(np.concatenate(keys), counts)
    ends = np.cumsum([len(k) for k in keys])
    each = [x.astype("<u8") for x in np.split(total[where], ends[:-1])]
    n = len(each)
    blocks = [*table.column("block").to_pylist(), None]
    return pa.table({
        "block": pa.array(blocks, pa.int64()), "kind": pa.array([kind] * (n + 1), pa.int32()), "part": pa.array([part] * (n + 1), pa.int64()),
        "counts": pa.array([*(_pack(x, 8) for x in each), None], pa.binary()),
        "n_keys": pa.array([None] * n + [int((total > 0).sum())], pa.int64()), "n_tokens": pa.array([None] * n + [int(total.sum())], pa.int64()),
    })


@dataclass
class _Block:
    """Tokens of a block with their corpus counts."""

    sizes: np.ndarray
    word: np.ndarray  # of each token: the count of its word,
    context: np.ndarray  # of the token before it,
    pair: np.ndarray  # of both
    word_at: np.ndarray  # and the numbers of word and pair within the block
    pair_at: np.ndarray

    @classmethod
    def of(cls, docs: pa.Table, answers: pa.Table, bits: int) -> _Block:
        tokens, sizes = _tokens(docs)
        told = {0: [], 1: []}
        rows = zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "counts")), strict=True)
        for kind, _, counts in sorted(rows):
            told[kind].append(_unpack(counts, 8).astype(np.int64))
        _, word_at = np.unique(tokens, return_inverse=True)
        _, pair_at = np.unique(_pairs(tokens, sizes, bits), return_inverse=True)
        word, pair = np.concatenate(told[0])[word_at], np.concatenate(told[1])[pair_at]
        ends = np.cumsum(sizes)
        context = np.r_[word[-1], word[:-1]]  # every text ends with the same token, which also stands before the first
        context[ends[:-1]] = word[ends[0] - 1]
        return cls(sizes, word, context, pair, word_at, pair_at)


def _bucket(context: np.ndarray) -> np.ndarray:
    """Context counts 0, 1, 2-3, 4-7 and so on."""
    return np.minimum(np.frexp(context.astype(float))[1], CONTEXT_BUCKETS - 1)


def _shares(word: np.ndarray, context: np.ndarray, pair: np.ndarray, totals: Totals) -> np.ndarray:
    return np.stack([pair / np.maximum(context, 1), word / max(1, totals.tokens), np.full(len(word), 1 / (totals.words + 1))])


def _held_out(bits: int, totals: Totals):
    """Of the training documents of a block, each without its own counts: how many tokens have about which shares."""

    def count(docs: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int32()), "a": pa.array([], pa.int32()), "b": pa.array([], pa.int32()), **{c: pa.array([], pa.float64()) for c in ("n", "p2", "p1")}})
        if not docs.num_rows or not answers.num_rows:
            return empty
        x = _Block.of(docs, answers, bits)
        doc = np.repeat(np.arange(len(x.sizes)), x.sizes)

        def own(at: np.ndarray) -> np.ndarray:
            _, where, n = np.unique(doc * (at.max() + 1) + at, return_inverse=True, return_counts=True)
            return n[where]

        own_word, own_pair = own(x.word_at), own(x.pair_at)
        ends = np.cumsum(x.sizes)
        own_context = np.r_[1, own_word[:-1]]
        own_context[ends[:-1]] = 1
        train = np.repeat(docs.column("train").to_numpy().astype(bool), x.sizes)
        p2, p1, _ = _shares(*(np.maximum(a - o, 0)[train] for a, o in ((x.word, own_word), (x.context, own_context), (x.pair, own_pair))), totals)
        bucket = _bucket(np.maximum(x.context - own_context, 0)[train])
        a, b = (np.where(p > 0, np.round(4 * np.log(np.maximum(p, 1e-12))), 1).astype(np.int64) for p in (p2, p1))
        # a and b lie between -111 and 1: with the bucket, one number names the cell.
        cells, where = np.unique(bucket.astype(np.int64) << 16 | (a + 128) << 8 | (b + 128), return_inverse=True)
        sums = {name: np.bincount(where, v, len(cells)) for name, v in (("n", np.ones(len(where))), ("p2", p2), ("p1", p1))} if len(where) else {name: np.zeros(0) for name in ("n", "p2", "p1")}
        return pa.table({"bucket": (cells >> 16).astype(np.int32), "a": ((cells >> 8 & 255) - 128).astype(np.int32), "b": ((cells & 255) - 128).astype(np.int32), **sums})

    return count


def learn_weights(cells: list[tuple[int, float, float, float]], totals: Totals, steps: int = 60) -> np.ndarray:
    """CONTEXT_BUCKETS x 3 mixture weights by expectation-maximisation from (bucket, tokens, sum of pair shares, sum of word shares)."""
    weights = np.full((CONTEXT_BUCKETS, 3), 1 / 3)
    if not cells:
        weights[:] = (0.3, 0.6, 0.1)
        return weights
    bucket = np.array([c[0] for c in cells])
    n = np.array([c[1] for c in cells])
    p = np.stack([[c[2] / c[1] for c in cells], [c[3] / c[1] for c in cells], np.full(len(cells), 1 / (totals.words + 1))], axis=1)
    for _ in range(steps):
        part = weights[bucket] * p
        part *= (n / part.sum(1))[:, None]
        for k in range(3):
            # One token shared by all three keeps a bucket without tokens, and every weight above zero.
            weights[:, k] = np.bincount(bucket, part[:, k], CONTEXT_BUCKETS) + 1 / 3
        weights /= weights.sum(1, keepdims=True)
    return weights


def _scores(bits: int, totals: Totals, weights: np.ndarray, id_type: pa.DataType):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], id_type), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], t) for c, t in (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))}})
        x = _Block.of(docs, answers, bits)
        start = np.r_[0, np.cumsum(x.sizes)[:-1]]
        base = np.log10((x.word + 1) / (totals.tokens + totals.words + 1))
        mixed = (weights[_bucket(x.context)].T * _shares(x.word, x.context, x.pair, totals)).sum(0)
        add = lambda v: np.add.reduceat(v, start)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": pa.array(~docs.column("train").to_numpy().astype(bool)),
            "n_tokens": pa.array(x.sizes.astype(np.int64)), "n_known": pa.array(add((x.word > 0).astype(np.int64))),
            "base_score": pa.array(add(base)), "score": pa.array(add(np.log10(mixed))),
        })

    return score


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of docs (doc_id, text).

    Learns from the rows outside the held-out fold. Null and empty texts are one end token; null ids count as fold
    0, are learnt from and keep their row; repeated rows are counted as often as they stand; an empty table gives no row. Words are told
    apart by 64-bit hashes, pairs by 48 bits and their range, together 64 bits at most. Other columns are not read.
    """
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = 1 + chars // BLOCK_CHARS
    bits = (-(-blocks // RANGE_BLOCKS) - 1).bit_length()
    key = row_key(F.col("doc_id"), F.col("text"))
    train = (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT).cast("int")
    texts = docs.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), "doc_id", train.alias("train"), F.col("text").cast("string").alias("text"))
    asked = texts.select("block", "train", "text").groupBy("block").applyInArrow(_questions(bits), "block long, kind int, part long, keys binary, counts binary")
    told = cut(asked.groupBy("kind", "part").applyInArrow(_answers, "block long, kind int, part long, counts binary, n_keys long, n_tokens long"), "counts")
    got = told.where("block is null and kind = 0").agg(F.sum("n_keys").alias("v"), F.sum("n_tokens").alias("n")).first()
    totals = Totals(got["n"] or 0, got["v"] or 0)
    answers = told.where("block is not null").select("block", "kind", "part", "counts")
    cells = texts.select("block", "train", "text").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_held_out(bits, totals), "bucket int, a int, b int, n double, p2 double, p1 double")
    # At most CONTEXT_BUCKETS times some 110 times 110 cells, whatever the input.
    summed = cells.groupBy("bucket", "a", "b").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).orderBy("bucket", "a", "b").collect()
    weights = learn_weights([(r["bucket"], r["n"], r["p2"], r["p1"]) for r in summed], totals)
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(bits, totals, weights, id_type), f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(totals.tokens).cast("long"))
