"""Fuzzy search: windows of words whose normalised text is close to a target."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import SPANS

# What is cut off behind a window, what does not count, and letters that readers of print confuse.
TRIM = ".,;:!?)]\"'"
IGNORED = "_-."
CONFUSED, MEANT = "01i|!58", "ollllsb"
PAIR, SINGLE = "rn", "m"
# Fixed values end here.
_WORDS = re.compile(r"\S+")
_MEANT = str.maketrans(CONFUSED, MEANT)
#: Scores and words that a task remembers at most, before it forgets them all.
REMEMBERED = 200_000


def normalised(value: Column) -> Column:
    """Lower case without white space and ignored characters, with confused letters made one."""
    plain = F.regexp_replace(F.lower(value), r"(?U)[\s_\-.]", "")
    return F.replace(F.translate(plain, CONFUSED, MEANT), F.lit(PAIR), F.lit(SINGLE))


def _letters(value: str) -> str:
    """As normalised, but for the pair of letters, which may stand in two words."""
    return "".join(c for c in value.lower() if not c.isspace() and c not in IGNORED).translate(_MEANT)


def normalise(value: str) -> str:
    """The same as normalised for a Python string."""
    return _letters(value).replace(PAIR, SINGLE)


def scorer(target: str) -> Callable[[str], int]:
    """200 times the longest common subsequence with the target over both lengths, rounded half to even.

    The rows of the usual table are single numbers, a bit for each character of the target.
    """
    places: dict[str, int] = {}
    for i, c in enumerate(target):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(target)) - 1

    def score(other: str) -> int:
        if not target or not other:
            return 100 if target == other else 0
        row = full
        for c in other:
            same = row & places.get(c, 0)
            row = (row + same | row - same) & full
        return round(200 * (len(target) - row.bit_count()) / (len(target) + len(other)))

    return score


def ratio(a: str, b: str) -> int:
    return scorer(a)(b)


class _Search:
    """Search of one target in texts, one after the other."""

    def __init__(self, target: str, width: int, threshold: int):
        self.target, self.width, self.threshold = target, width, threshold
        self.slack = max(2, len(target) // 3)
        self.score, self.memo = scorer(target), {}
        self.known: dict[str, tuple[str, str, int, int]] = {}
        self.alphabet = sorted(set(target) | set(PAIR + SINGLE))
        self.wanted = np.array([target.count(c) for c in self.alphabet])
        self.at = {c: i for i, c in enumerate(self.alphabet)}
        self.counts = np.zeros((1024, len(self.alphabet)), np.int32)

    def _word(self, word: str) -> tuple[str, str, int, int]:
        """(letters, letters without what is trimmed behind, characters trimmed, number among the counts)."""
        short = word.rstrip(TRIM)
        letters, at = _letters(word), len(self.known)
        if at == len(self.counts):
            self.counts = np.r_[self.counts, np.zeros_like(self.counts)]
        self.counts[at] = [letters.count(c) for c in self.alphabet]
        self.known[word] = got = (letters, _letters(short) if short != word else letters, len(word) - len(short), at)
        return got

    def _likely(self, counts: np.ndarray, sizes: np.ndarray, trimmed: int, k: int) -> np.ndarray:
        """Windows of k words that may score enough, by how many letters they share with the target at most.

        Trimming takes at most so many letters from a window.
        """
        n = len(sizes) - k + 1
        have, size = sum(counts[j : j + n] for j in range(k)), sum(sizes[j : j + n] for j in range(k))
        r, two, one = (have[:, self.at[c]] for c in (*PAIR, SINGLE))
        pairs = np.minimum(r, two)  # so many may become single letters
        more = have.copy()
        more[:, self.at[SINGLE]] = one + pairs
        shared = np.minimum(more, self.wanted).sum(1)
        least = size - pairs - trimmed
        fits = (least <= len(self.target) + self.slack) & (size >= len(self.target) - self.slack)
        return np.flatnonzero(fits & (200 * shared >= (self.threshold - 0.5) * (len(self.target) + np.maximum(shared, least))))

    def __call__(self, text: str) -> list[dict]:
        """Windows of about width words that score at least the threshold; of overlapping ones the best, then the first."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        if len(self.memo) > REMEMBERED:
            self.memo = {}
        spots = [(m.start(), m[0]) for m in _WORDS.finditer(text)]
        words = [self.known.get(w) or self._word(w) for _, w in spots]
        if not words:
            return []
        counts, sizes = self.counts[[w[3] for w in words]], np.array([len(w[0]) for w in words])
        trimmed = max(len(w[0]) - len(w[1]) for w in words)
        found = []
        for order, k in enumerate(dict.fromkeys(k for k in (self.width, self.width - 1, self.width + 1) if k >= 1)):
            if len(words) < k:
                continue
            for i in self._likely(counts, sizes, trimmed, k).tolist():
                last = words[i + k - 1]
                start = spots[i][0]
                end = spots[i + k - 1][0] + len(spots[i + k - 1][1]) - last[2]
                plain = ("".join(w[0] for w in words[i : i + k - 1]) + last[1]).replace(PAIR, SINGLE)
                if end > start and plain and abs(len(plain) - len(self.target)) <= self.slack:
                    if plain not in self.memo:
                        self.memo[plain] = self.score(plain)
                    if self.memo[plain] >= self.threshold:
                        found.append((-self.memo[plain], start, order, i, end))
        kept: list[tuple[int, int]] = []
        for _, start, _, _, end in sorted(found):
            at = bisect(kept, (start, end))
            if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
                kept.insert(at, (start, end))
        return [{"start": s, "length": e - s, "text": text[s:e]} for s, e in kept]


def fuzzy_spans(text: Column, pattern: str, threshold: int = 85) -> Column:
    """array<struct<start,length,text>>: windows of as many words as the pattern has, one fewer or one more, that
    are like it. Letter counts leave out nearly all windows of a text at once; the rest are scored."""
    target = normalise(pattern)
    if not target:
        return F.array().cast(SPANS)
    width = max(1, len(pattern.split()))

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        search = _Search(target, width, threshold)
        return texts.map(lambda t: search(t or ""))

    return run(text)
