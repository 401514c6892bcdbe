"""Near-duplicate groups by 64-bit SimHash, compared with bit planes.

Every distinct fingerprint is a node. Five blocks of bits give ten pairs of blocks; two
fingerprints that differ in at most three bits agree on at least one pair, so candidates are
the fingerprints that share a pair. Within such a bucket the fingerprints are stored by bit
planes, 64 to a word, and all distances to a query grow together in bitwise counters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, if_few, row_key, utf8
from .components import components

BITS, BLOCKS, MAX_DISTANCE, SHINGLE, SEED = 64, 5, 3, 3, 42
#: Fingerprints of one bucket that meet in one comparison; larger buckets are compared chunk by chunk.
CHUNK = 2048
#: Rows that one call of the comparison gets, about.
CALL_ROWS = 8192

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANES = np.uint64(64)


def fingerprint(text: bytes) -> int:
    """SimHash of the 3-word shingles of a text as a signed 64-bit integer; 0 for no words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=np.uint8)
    n = len(raw) // 8
    cells = (raw.reshape(n, 8) + (np.arange(8, dtype=np.int16) << 8)).ravel()
    counts = np.bincount(cells, minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array(map(fingerprint, utf8(batch.column(2))), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], ["doc_id", "row_key", "print"])


def _close(rows: np.ndarray, planes: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int) -> np.ndarray:
    """For each (query row, block of 64 lanes): the lanes within radius, as bits of a word.

    ones, twos and over are a carry-save counter per lane; over is set once a lane has passed
    the radius, and a pair of query and block is left as soon as all its lanes are over.
    """
    if radius != 3:
        raise ValueError("the counters hold distances up to three")
    found = np.zeros(len(query), np.uint64)
    live = np.arange(len(query))
    ones, twos, over = (np.zeros(len(query), np.uint64) for _ in range(3))
    for bit in range(BITS):
        asked = np.uint64(0) - ((rows[query[live]] >> np.uint64(bit)) & np.uint64(1))
        differs = planes[bit][block[live]] ^ asked
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        if bit % 8 == 7:
            keep = over != np.uint64(0xFFFFFFFFFFFFFFFF)
            if not keep.all():
                live, ones, twos, over = live[keep], ones[keep], twos[keep], over[keep]
                if not len(live):
                    return found
    found[live] = ~over
    return found


def links(prints: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each group, all that pairs within the radius connect.

    prints: uint64; group: sorted group numbers; side: 0 compares a group with itself, else rows of
    side 1 are compared with rows of side 2. A dense group gives a tree, never all its pairs.
    """
    n = len(prints)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    part = group.astype(np.int64) * 4 + side
    order = np.argsort(part, kind="stable")
    prints, group, side, part = prints[order], group[order], side[order], part[order]
    first = np.r_[True, part[1:] != part[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    lane = (np.arange(n) - start) % 64
    block_first = np.flatnonzero(lane == 0)
    block_of = np.cumsum(lane == 0) - 1
    planes = np.empty((BITS, len(block_first)), np.uint64)
    for bit in range(BITS):
        planes[bit] = np.bitwise_or.reduceat(((prints >> np.uint64(bit)) & np.uint64(1)) << lane.astype(np.uint64), block_first)
    used = np.bitwise_or.reduceat(np.uint64(1) << lane.astype(np.uint64), block_first)
    # The blocks that each query meets: those of its own part, or those of side 2 for a query of side 1.
    numbers, at = np.unique(part, return_index=True)
    low, high = block_of[at], np.r_[block_of[at[1:]], len(block_first)]
    want = np.where(side == 0, part, np.where(side == 1, part + 1, -1))
    pos = np.searchsorted(numbers, want)
    pos = np.where((pos < len(numbers)) & (numbers[np.minimum(pos, len(numbers) - 1)] == want), pos, -1)
    queries = np.flatnonzero(pos >= 0)
    width = (high - low)[pos[queries]]
    query = np.repeat(queries, width)
    block = np.repeat(low[pos[queries]], width) + np.arange(len(query)) - np.repeat(np.cumsum(width) - width, width)
    near = np.zeros(len(query), np.uint64)
    for i in range(0, len(query), 1 << 16):
        s = slice(i, i + (1 << 16))
        near[s] = _close(prints, planes, query[s], block[s], radius) & used[block[s]]
    same = block_of[query] == block
    near[same] &= ~(np.uint64(1) << lane[query[same]].astype(np.uint64))
    hit = near != 0
    return _trees(prints, query[hit], block_first[block[hit]], near[hit])


def _trees(prints: np.ndarray, query: np.ndarray, base: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that the lane words describe."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    left, right = [], []
    joined: dict[tuple[int, int], int] = {}  # (root, block): lanes that are known to be under the root
    for q, b, word in zip(query.tolist(), base.tolist(), near.tolist(), strict=True):
        root = find(q)
        word &= ~joined.get((root, b), 0)
        rest = word
        while rest:
            low = rest & -rest
            rest ^= low
            other = find(x := b + low.bit_length() - 1)
            if other != root:
                parent[other] = root
                left.append(q)
                right.append(x)
        if word:
            joined[root, b] = joined.get((root, b), 0) | word
    return prints[np.array(left, np.int64)], prints[np.array(right, np.int64)]


def _compare(data: pa.Table) -> pa.Table:
    """All buckets of one call: columns bucket, side, print."""
    _, group = np.unique(data.column("bucket").to_numpy(), return_inverse=True)
    a, b = links(data.column("print").to_numpy().view(np.uint64), group, data.column("side").to_numpy())
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def _block_masks() -> list[int]:
    """Of each pair of blocks the mask of its bits, as a signed integer."""
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(BLOCKS)]
    masks = [x | y for x, y in combinations(block, BLOCKS - MAX_DISTANCE)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect every two of the distinct fingerprints (column print) within three bits."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("print").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_block_masks())])
    keyed = prints.select("print", F.explode(tables).alias("x")).select("print", "x.t", "x.k")
    sizes = cut(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    placed = keyed.join(sizes, ["t", "k"]).withColumn("chunks", F.ceil(F.col("n") / CHUNK))
    own = F.pmod(F.xxhash64("print", F.lit("chunk")), "chunks")
    # Row of chunk c meets itself at (c, c) and every other chunk at (smaller, larger).
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, "c").alias("i"), F.greatest(o, "c").alias("j"), F.when(o == F.col("c"), 0).when(F.col("c") < o, 1).otherwise(2).cast("long").alias("side")))
    met = placed.withColumn("c", own).select("print", "t", "k", F.explode(meets).alias("m"))
    bucketed = met.select("print", "m.side", F.xxhash64("t", "k", "m.i", "m.j").alias("bucket"))
    rows = sizes.agg(F.sum(F.col("n") * F.ceil(F.col("n") / CHUNK))).first()[0] or 0
    calls = max(64, -(-rows // CALL_ROWS))
    return bucketed.withColumn("call", F.pmod("bucket", F.lit(calls))).groupBy("call").applyInArrow(_compare, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, print, first_id, first_key): one row for each row of docs.

    first_id is the smallest id of the component and first_key the key of the row that stands for it.
    Null or empty texts have fingerprint 0 and link like any other. Null ids are allowed; they come
    after all others. Rows that repeat an id and text share their row_key. An empty table gives no row.
    Columns of docs other than the two named are not read.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([read.schema["doc_id"], read.schema["row_key"], T.StructField("print", T.LongType())])
    marked = cut(read.mapInArrow(_fingerprints, schema), "prints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    nodes = cut(marked.groupBy("print").agg(F.min(order).alias("first")), "nodes")
    groups = components(near_links(nodes.select("print")), "a", "b")
    firsts = nodes.join(groups, nodes["print"] == groups["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    smallest = firsts.groupBy("root").agg(F.min("first").alias("least"))
    placed = firsts.join(smallest, "root").select(F.col("print").alias("of_print"), F.col("least.doc_id").alias("first_id"), F.col("least.row_key").alias("first_key"))
    return marked.join(placed, marked["print"] == placed["of_print"]).drop("of_print")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest id stays, once."""
    grouped = cut(simhash_components(docs, id_col, text_col).select("row_key", (F.col("row_key") == F.col("first_key")).alias("stays")), "grouped")
    gone = cut(grouped.where("not stays").select(F.col("row_key").alias("__gone_key")).distinct(), "gone")
    key = row_key(docs[id_col], docs[text_col])
    out = docs.join(if_few(gone, gone.count()), key == gone["__gone_key"], "left_anti")
    stay = grouped.where("stays").agg(F.count("*").alias("n"), F.count_distinct("row_key").alias("d")).first()
    if stay["n"] > stay["d"]:  # rows that repeat an id and text
        out = out.select(F.struct(*[out[c] for c in out.columns]).alias("row"), key.alias("key")).dropDuplicates(["key"]).select("row.*")
    return out
