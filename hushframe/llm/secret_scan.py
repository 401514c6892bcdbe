"""Secret scans: base patterns, and formats inferred from what the base patterns find.

The values that the base patterns find in the corpus are the labelled credentials. For each kind a
probabilistic automaton is inferred from a bounded sample of them, and one from tokens that come again in other
texts, as credentials seldom do. Every token of the credentials' alphabet is scored in place; those are added
whose likelihood lies where that of the credentials lies, and which are far likelier as credentials than as common tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Automaton, infer
from .common import cut, utf8

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a longest run of hex digits, if it has 24 or more
_WORDS = ("passw", "secret", "token", "api")  # one of them stands in every match of _ASSIGN
#: A candidate: six characters or more, with dots inside and = behind only.
_TOKEN = re.compile(r"[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{4,}[A-Za-z0-9+/_-]={0,2}")
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_.=-")
_CLASS = str.maketrans({c: str(i) for i, cs in enumerate(_CLASSES) for c in cs})
_SHAPE = str.maketrans("012345", "000001")
_TOKENS = len(KINDS) - 1
#: Bins of a doubling of the hash: each holds about one in 90 of what is below it.
HASH_BINS = 64
#: Verdicts on tokens that a task remembers at most, before it forgets them all.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Settings:
    #: Credentials of each kind: one half teaches its automaton, the other half says how likely they are.
    credentials: int = 1200
    #: Tokens outside credentials; those of them that come in two texts or more teach the automaton of common tokens.
    tokens: int = 6000
    #: Characters of all of a kind's credentials together; of those in a seeded order, as many are used as fit.
    characters: int = 100_000
    #: Share of the credentials that may be less likely than the range of a format, and share that may be likelier.
    beyond: float = 0.02
    #: By how much a token must be likelier as a credential than as a common token, as a logarithm: a thousand times.
    margin: float = 7.0


@dataclass
class Format:
    """Two automata of a kind: what its classes of characters are, and how long it is and where signs stand in it."""

    kind: str
    classes: Automaton
    shape: Automaton
    low: float
    high: float
    least: float

    def score(self, classes: str) -> float | None:
        """The likelihood of the classes, where it lies in the range of credentials (a dull token may be likelier
        than any of them) and the shape is as likely as theirs."""
        x = self.classes.score(classes)
        return x if self.low <= x <= self.high and self.shape.score(classes.translate(_SHAPE)) >= self.least else None


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, value) of the base patterns, by start and then kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        found += [(m.start(), m.end(), 0, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


class Judge:
    """Whether tokens are likely credentials; verdicts are remembered, as most tokens come again."""

    def __init__(self, formats: list[Format], common: Automaton | None, margin: float):
        self.formats, self.common, self.margin = formats, common, margin
        self.known: dict[str, bool] = {}

    def __call__(self, token: str) -> bool:
        if (verdict := self.known.get(token)) is None:
            if len(self.known) >= REMEMBERED:
                self.known = {}
            classes = token.translate(_CLASS)
            best = max((x for f in self.formats if (x := f.score(classes)) is not None), default=None)
            verdict = best is not None and (self.common is None or (best - self.common.score(classes)) * (len(classes) + 1) >= self.margin)
            self.known[token] = verdict
        return verdict

    def __reduce__(self):
        return Judge, (self.formats, self.common, self.margin)


def format_spans(text: str, judge: Judge, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Likely tokens, but for those that lie within a base span."""
    if not judge.formats or not any(map(judge, set(_TOKEN.findall(text)))):
        return []
    likely = [(m.start(), m.end(), 3, m[0]) for m in _TOKEN.finditer(text) if judge(m[0])]
    return [x for x in likely if not any(s <= x[0] and x[1] <= e for s, e, _, _ in base)]


def _samples(settings: Settings):
    """(kind, value, h, n): of a batch the credentials and tokens that may be among the first by hash h, and how many of its texts hold them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[Counter[str]] = [Counter() for _ in KINDS]
            for raw in utf8(batch.column(0)):
                text = raw.decode()
                base = base_spans(text)
                for k in range(_TOKENS):
                    found[k].update({v for _, _, x, v in base if x == k})
                if base:
                    found[_TOKENS].update({m[0] for m in _TOKEN.finditer(text) if not any(s < m.end() and m.start() < e for s, e, _, _ in base)})
                else:
                    found[_TOKENS].update(set(_TOKEN.findall(text)))
            first = [(k, v, h, some[v]) for k, some in enumerate(found) for h, v in sorted((xxhash.xxh64_intdigest(v) >> 1, v) for v in some)[: settings.tokens if k == _TOKENS else settings.credentials]]
            columns = zip(*first, strict=True) if first else [[]] * 4
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "value", "h", "n"])

    return rows


def learn_formats(docs: DataFrame, settings: Settings = Settings()) -> Judge:
    """Automata of the kinds of credentials that docs (text) hold, from all texts read once, and of common tokens."""
    seen = docs.select(F.col("text").cast("string")).mapInArrow(_samples(settings), "kind int, value string, h long, n long")
    most = {k: settings.tokens if k == _TOKENS else settings.credentials for k in range(len(KINDS))}
    # Of each kind the first by hash, which every batch that has them sends. How many have about which hash says how far to
    # read: a few thousand numbers, then as many rows as wanted and one bin more reach the driver, however many there are.
    bin_of = F.floor(F.log2(F.col("h") + 1.0) * HASH_BINS).cast("int")
    seen = cut(seen.groupBy("kind", "value", "h").agg(F.sum("n").alias("n")).withColumn("bin", bin_of), "tokens")
    until, sums = {}, Counter()
    for r in seen.groupBy("kind", "bin").count().orderBy("kind", "bin").collect():
        if sums[r["kind"]] < most[r["kind"]]:
            until[r["kind"]] = r["bin"]
        sums[r["kind"]] += r["count"]
    near = [(F.col("kind") == k) & (F.col("bin") <= b) for k, b in until.items()]
    found = sorted(seen.where(reduce(or_, near)).collect(), key=lambda r: (r["kind"], r["h"], r["value"])) if near else []
    rows = [r for k in most for r in [x for x in found if x["kind"] == k][: most[k]]]
    formats = []
    for k, kind in enumerate(KINDS[:_TOKENS]):
        classes, left = [], settings.characters
        for r in rows:
            if r["kind"] == k and len(r["value"]) <= left:
                classes.append(r["value"].translate(_CLASS))
                left -= len(r["value"])
        if classes:
            taught, other = classes[::2], classes[1::2] or classes
            fine, shape = infer(taught, len(_CLASSES)), infer([c.translate(_SHAPE) for c in taught], 2)
            scores, shapes = sorted(map(fine.score, other)), sorted(shape.score(c.translate(_SHAPE)) for c in other)
            out = int(settings.beyond * len(other))
            formats.append(Format(kind, fine, shape, scores[out], scores[-1 - out], shapes[out]))
    usual = [r["value"].translate(_CLASS) for r in rows if r["kind"] == _TOKENS and r["n"] > 1]
    return Judge(formats, infer(usual, len(_CLASSES)) if usual else None, settings.margin)


def _shown(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k, _ in spans)


def _scan(judge: Judge):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in range(5)]
            base_text, all_text = [], []
            for raw in utf8(batch.column(1)):
                text = raw.decode()
                base = base_spans(text)
                every = sorted(base + format_spans(text, judge, base))
                for k in range(4):
                    counts[k].append(sum(x[2] == k for x in every))
                counts[4].append(sum(judge(v) for _, _, _, v in base))
                base_text.append(_shown(base))
                all_text.append(_shown(every))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_text, pa.string()), pa.array(all_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "n_format", "n_likely", "base", "spans"])

    return rows


def scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_format, n_likely, base, spans): one row for each row of docs (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, ordered by start and then kind; n_likely counts the base values
    that the inferred formats would have found too. Null text counts as
    empty; null ids keep their row; repeated rows get equal spans; an empty table gives no row. Other columns are not read.
    """
    return _scanned(docs, learn_formats(docs, settings))


def scan_base(docs: DataFrame) -> DataFrame:
    """As scan, with the base patterns alone: nothing is learnt, and n_format and n_likely are 0."""
    return _scanned(docs, Judge([], None, 0.0))


def _scanned(docs: DataFrame, judge: Judge) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string"))
    return texts.mapInArrow(_scan(judge), f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_format long, n_likely long, base string, spans string")


def _redact(judge: Judge, at: int, mask: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, known in zip(utf8(batch.column(at)), batch.column(at).is_valid().to_pylist(), strict=True):
                text, pieces, end = raw.decode(), [], 0
                base = base_spans(text)
                for s, e, _, _ in sorted(base + format_spans(text, judge, base)):
                    if s >= end:
                        pieces += [text[end:s], mask]
                    end = max(end, e)
                out.append("".join([*pieces, text[end:]]) if known else None)
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(out, pa.string()))

    return rows


def redact(docs: DataFrame, mask: str = "[secret]", settings: Settings = Settings()) -> DataFrame:
    """docs with every found span, touching or overlapping ones together, replaced by mask; n_chars, where there is one, follows.

    All rows and columns stay; null text stays null.
    """
    judge = learn_formats(docs, settings)
    clean = docs.mapInArrow(_redact(judge, docs.columns.index("text"), mask), docs.schema)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
