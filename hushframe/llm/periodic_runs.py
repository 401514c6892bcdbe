"""Runs of words that repeat with a period, found in a suffix automaton whose states' end positions are merged small into large.

Each text is a row of its own: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import utf8

#: Words that a run has at least.
LEAST = 12
#: A run's words lie in windows of so many words that its stretch holds twice: half of LEAST.
_SEED = LEAST // 2
#: Positions that one block of a large set holds at most.
_BLOCK = 512

Run = tuple[int, int, int]


class _Ends:
    """An ordered set of end positions in blocks, so that an insertion moves few of them."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, first: int) -> None:
        self.blocks, self.heads, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Put x in; its neighbours before and behind."""
        at = max(bisect_left(self.heads, x) - 1, 0)
        block = self.blocks[at]
        i = bisect_left(block, x)
        before = block[i - 1] if i else None
        behind = block[i] if i < len(block) else self.heads[at + 1] if at + 1 < len(self.heads) else None
        block.insert(i, x)
        self.heads[at] = block[0]
        self.size += 1
        if len(block) > _BLOCK:
            self.blocks[at : at + 1] = block[: _BLOCK // 2], block[_BLOCK // 2 :]
            insort(self.heads, block[_BLOCK // 2])
        return before, behind


def _automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, end) of the states of the suffix automaton; end: a position for a state of a prefix, -1 for a clone."""
    length, link, end, to = [0], [-1], [-1], [{}]
    last = 0
    for at, c in enumerate(word):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(at)
        to.append({})
        p = last
        while p != -1 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p != -1:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                to.append(to[q].copy())
                while p != -1 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return length, link, end


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first elements of both are alike."""
    n, at, step = min(len(a), len(b)), 0, 16
    a, b = a[:n], b[:n]
    while at < n:
        differs = a[at : at + step] != b[at : at + step]
        if differs.any():
            return at + int(differs.argmax())
        at, step = at + step, step * 2
    return n


def _stretch_runs(word: np.ndarray, first: int) -> set[Run]:
    """Runs of a stretch that begins at word number first. A pair of end positions of a state that are no farther apart than
    the state is long is a square; squares of one period that lie in a run known already add nothing."""
    length, link, end = _automaton(word.tolist())
    ends: list[_Ends | None] = [_Ends(e) if e >= 0 else None for e in end]
    known: dict[int, list[tuple[int, int]]] = {}
    found: dict[tuple[int, int], int] = {}
    n = len(word)
    back = word[::-1]

    def square(a: int, b: int) -> None:
        """Ends a and b, b - a = d apart: words a+1-d .. b repeat with period d."""
        d = b - a
        mine = known.setdefault(d, [])
        i = bisect_left(mine, (a + 1 - d, n + 1)) - 1
        if i >= 0 and b < mine[i][1]:
            return
        lo, hi = a + 1 - d, b + 1
        hi += _same(word[hi:], word[hi - d :])
        lo -= _same(back[n - lo :], back[n - lo - d :])
        insort(mine, (lo, hi))
        if hi - lo >= LEAST and found.get((lo, hi), d) >= d:
            found[lo, hi] = d

    for s in np.argsort(length, kind="stable")[::-1].tolist():
        up = link[s]
        if up <= 0:
            ends[s] = None
            continue
        small, large = ends[s], ends[up]
        ends[s] = None
        if large is None:
            ends[up] = small
            continue
        if small.size > large.size:
            small, large = large, small
        reach = length[up]
        for x in small:
            before, behind = large.add(x)
            if before is not None and x - before <= reach:
                square(before, x)
            if behind is not None and behind - x <= reach:
                square(x, behind)
        ends[up] = large
    return {(first + lo, hi - lo, d) for (lo, hi), d in found.items()}


def _twice(word: np.ndarray) -> np.ndarray:
    """Which words lie in a window of _SEED words whose hash occurs twice."""
    n = len(word) - _SEED + 1
    h = np.zeros(n, np.uint64)
    for k in range(_SEED):
        h = (h ^ word[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    step = np.zeros(len(word) + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.subtract.at(step, at + _SEED, 1)
    return np.cumsum(step[:-1]) > 0


def runs(word: np.ndarray) -> list[Run]:
    """(start, length, period) of all runs of numbered words, by start and period.

    Each word of a run lies in a window of half the least length that the run holds twice. So a stretch without such
    windows holds no run, and stretches shrink, each by itself, until all their words lie in windows that they repeat.
    """
    found: set[Run] = set()
    rest = [(0, len(word))]
    while rest:
        lo, hi = rest.pop()
        if hi - lo < LEAST:
            continue
        inside = np.concatenate(([0], _twice(word[lo:hi]).view(np.int8), [0]))
        turns = np.flatnonzero(np.diff(inside))
        parts = [(lo + int(a), lo + int(b)) for a, b in zip(turns[::2], turns[1::2], strict=True)]
        if parts == [(lo, hi)]:
            found |= _stretch_runs(word[lo:hi], lo)
        else:
            rest += parts
    return sorted(found)


def with_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words; those of every tenth id repeat with a period that follows from the id, from a word on that does so too."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapsed(n: int, found: list[Run]) -> np.ndarray:
    """Which of n words stay: a run keeps its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


_SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"


def _judge(batches: Iterator[pa.RecordBatch], tails: bool, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            words = text.split()
            if tails:
                words = with_tail(words, doc_id)
            number: dict[bytes, int] = {}
            found = runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
            stays = collapsed(len(words), found)
            kept = b" ".join(words if stays.all() else [w for w, s in zip(words, stays.tolist(), strict=True) if s])
            best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
            lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
            rows.append((doc_id, len(words), len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            size += len(kept) if keep_text else 0
            if size > 1 << 22:
                yield _batch(rows)
                rows, size = [], 0
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 3
    names = [part.split()[0] for part in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def periodic_runs(docs: DataFrame, tails: bool = False, keep_text: bool = True) -> DataFrame:
    """One row for each row of docs (doc_id, text; others are ignored): doc_id, n_words, n_runs, the longest run's start, length,
    period and exponent_milli (ties: smallest start, then period), runs_sha256, collapsed_sha256, and collapsed: the text with one
    period of each run, words joined by one space, if keep_text.

    Words are separated by space and U+0009 to U+000D. Null and empty texts have no words and no runs; repeated rows are
    judged each; no rows give none. tails replaces words as with_tail does (null ids: not at all).
    """
    rows = docs.selectExpr("cast(doc_id as long) AS doc_id", "text")
    return rows.mapInArrow(lambda batches: _judge(batches, tails, keep_text), _SCHEMA)

