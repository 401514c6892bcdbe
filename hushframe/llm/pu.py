"""Positive-unlabelled learning of text classes with the non-negative risk estimator.

A linear model over binary features is fitted from trusted positives and unlabelled texts: the risk on
negatives is the risk of the unlabelled texts less the positives' share in it, and is kept from going
below zero. The positives' share (class prior) is estimated from the same two samples, whatever other labels
there are. Fitting uses bounded samples (parameters); scoring reads every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, utf8

STYLE = ("words", "word_length", "distinct", "upper", "digit", "symbol", "non_ascii", "repeated_lines", "same_as_last", "line_words")
BINS = 8
#: Standard errors by which the shares of a mark must differ; chance reaches this about once in 16,000 marks.
SURE = 4
_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"
_PLAIN = bytes(c for c in range(128) if chr(c).isalnum() or c in b" \t\n\x0b\x0c\r.,;:'\"()-")
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Lengths in bytes of the beginnings of words, and the share of a text's words that must have one for it to count.
PREFIXES, SHARE = (4, 5, 6, 7, 8), 0.012
#: Parts of the sample, each of which is scored by a model of the others when the class prior is estimated.
PARTS = 5
#: Steps of those models, which only have to order the texts.
ORDER_STEPS = 80
_ALL = bytes(range(256))
_NOT_UPPER = bytes(c for c in _ALL if c not in _UPPER)
_NOT_DIGIT = bytes(c for c in _ALL if c not in _DIGIT)
_ASCII = bytes(range(128))


@dataclass(frozen=True)
class Sizes:
    """Bounds of the samples and of the model."""

    positives: int = 6000
    unlabelled: int = 12000
    marks: int = 800
    seed: int = 7


@dataclass
class Model:
    prior: float
    bias: float = 0.0
    edges: list[list[float]] = field(default_factory=list)
    style: list[list[float]] = field(default_factory=list)
    marks: dict[bytes, float] = field(default_factory=dict)


def describe(text: bytes) -> tuple[list[float], set[bytes]]:
    """Style figures of a whole text, and its marks: the lower-cased words, as they are and without
    symbols at their ends, and the beginnings that many of the words share (with * or ** behind them)."""
    words = text.lower().split()
    n, size = max(1, len(words)), max(1, len(text))
    kinds = set(words)
    marks = kinds | {w.strip(_SYMBOLS) for w in kinds}
    for length in PREFIXES:
        for prefix, often in Counter(map(itemgetter(slice(length)), words)).most_common(len(words) and 1 + int(1 / SHARE)):
            if often < 2 or often < SHARE * n:
                break
            marks.add(prefix + (b"**" if often >= 3 and often >= 3 * SHARE * n else b"*"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        len(kinds) / n,
        len(text.translate(None, _NOT_UPPER)) / size,
        len(text.translate(None, _NOT_DIGIT)) / size,
        len(text.translate(None, _PLAIN + bytes(range(128, 256)))) / n,
        len(text.translate(None, _ASCII)) / size,
        1 - len(set(lines)) / max(1, len(lines)),
        same / n,
        float(np.log1p(n / max(1, len(lines)))),
    ], marks


def _sample(docs: DataFrame, positives: DataFrame, sizes: Sizes) -> DataFrame:
    """(text, pos, unl, part): texts of at most so many positives and of at most so many documents, labelled or not."""
    order = F.xxhash64("doc_id", F.lit(sizes.seed))
    ids = docs.select("doc_id").where("doc_id is not null")
    p = positives.orderBy(order).limit(sizes.positives).select("doc_id", F.lit(1).alias("pos"), F.lit(0).alias("unl"))
    u = ids.orderBy(order, "doc_id").limit(sizes.unlabelled).distinct().select("doc_id", F.lit(0).alias("pos"), F.lit(1).alias("unl"))
    # At most positives + unlabelled rows of three numbers: safe to broadcast at any input size.
    chosen = p.union(u).groupBy("doc_id").agg(F.max("pos").alias("pos"), F.max("unl").alias("unl"))
    # However often an id stands, it is here once, with the first of its texts, so that reruns fit alike.
    found = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("pos").alias("pos"), F.max("unl").alias("unl"))
    return cut(found.select("text", "pos", "unl", F.pmod(F.xxhash64("doc_id", F.lit(sizes.seed + 1)), F.lit(PARTS)).cast("int").alias("part")), "sample")


def _all_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = pa.array([list(describe(t)[1]) for t in utf8(batch.column(0))], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), marks], ["pos", "unl", "marks"])


def _choose_marks(sample: DataFrame, sizes: Sizes) -> list[bytes]:
    """The marks whose share of texts differs most surely between positives and unlabelled texts."""
    totals = sample.agg(F.sum("pos").alias("p"), F.sum("unl").alias("u")).first()
    n_p, n_u = max(1, totals["p"] or 0), max(1, totals["u"] or 0)
    seen = sample.mapInArrow(_all_marks, "pos int, unl int, marks array<binary>").select("pos", "unl", F.explode("marks").alias("mark"))
    counts = seen.groupBy("mark").agg(F.sum("pos").alias("p"), F.sum("unl").alias("u")).where("p + u >= 4")
    share = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    top = counts.select("mark", z.alias("z")).where(f"z > {SURE}").orderBy(F.desc("z"), "mark").limit(sizes.marks)
    return [bytes(r["mark"]) for r in top.collect()]


def _featurised(numbers: dict[bytes, int]):
    known = numbers.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, sorted(numbers[m] for m in known & marks)) for s, marks in map(describe, utf8(batch.column(0)))]
            style = pa.array([s for s, _ in rows], pa.list_(pa.float64()))
            found = pa.array([f for _, f in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], style, found], ["pos", "unl", "part", "style", "found"])

    return run


def _bins(style: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(e, style[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(style) else np.zeros((0, len(edges)), int)


def _descend(x: np.ndarray, gradient, l2: float, steps: int = 250, rate: float = 0.05) -> np.ndarray:
    """Adam steps, all in x's 32 bits: a wider weight or l2 would have every product copy all of x."""
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        g = (gradient(w) + np.float32(l2) * w * (np.arange(len(w)) > 0)).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(score_p: np.ndarray, score_u: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio, over thresholds, of the shares above it.

    Above a high threshold the unlabelled texts are nearly all positive, so that the ratio comes near the
    prior; a term for the sampling error keeps thresholds with few texts from deciding.
    """
    cuts = np.unique(np.quantile(score_p, np.linspace(0, 0.95, 96)))
    above_p = (score_p[None] >= cuts[:, None]).mean(1)
    above_u = (score_u[None] >= cuts[:, None]).mean(1)
    slack = np.sqrt(np.log(40) / 2 / len(score_p)) + np.sqrt(np.log(40) / 2 / len(score_u))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def _apart(xp: np.ndarray, xu: np.ndarray, l2: float) -> np.ndarray:
    """Weights that tell positives from unlabelled texts, both counted alike; they only order the texts."""
    return _descend(xp, lambda w: xp.T @ (_sigmoid(xp @ w) - 1) / len(xp) + xu.T @ _sigmoid(xu @ w) / len(xu), l2, ORDER_STEPS)


def risk(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float]:
    """Mean logistic losses: of the positives as such, times the prior, and of the negatives: the unlabelled less the positives among them."""
    zp, zu = xp @ w, xu @ w
    return float(prior * np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def minimise(xp: np.ndarray, xu: np.ndarray, prior: float, l2: float) -> np.ndarray:
    """Weights of the least non-negative risk: where the risk of the negatives falls below zero, the step raises it."""

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = xp @ w, xu @ w
        on_p = xp.T @ _sigmoid(zp) / len(xp)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = xu.T @ _sigmoid(zu) / len(xu) - prior * on_p
        if negative < 0:
            return -g_negative
        return prior * (xp.T @ (_sigmoid(zp) - 1)) / len(xp) + g_negative

    return _descend(xp, gradient, l2)


def level(logits: np.ndarray, prior: float, threshold: float) -> float:
    """What to add, zero or less, to the logits of unlabelled texts, so that the share of them that reaches the threshold is
    at most the prior and one standard error of it."""
    share = min(1.0, prior + np.sqrt(prior * (1 - prior) / len(logits)))
    return min(0.0, float(np.log(threshold / (1 - threshold)) - np.quantile(logits, 1 - share)))


def fit(docs: DataFrame, positives: DataFrame, sizes: Sizes = Sizes(), threshold: float = 0.5) -> Model:
    """Model of the class of positives (column doc_id) from docs (doc_id, text). No positive text: a model without features.

    threshold: the score from which a text is to count as positive, which sets the model's level.
    """
    sample = _sample(docs, positives, sizes)
    marks = {m: i for i, m in enumerate(_choose_marks(sample, sizes))}
    data = sample.mapInArrow(_featurised(marks), "pos int, unl int, part int, style array<double>, found array<int>").toArrow()
    pos, unl = (data.column(c).to_numpy() == 1 for c in ("pos", "unl"))
    if pos.sum() < 2 or unl.sum() < 2:
        return Model(prior=0.5)
    part, style, found = data.column("part").to_numpy(), np.array(data.column("style").to_pylist()), data.column("found").to_pylist()
    # So that reruns see the same order.
    order = sorted(range(len(style)), key=lambda i: (style[i].tolist(), found[i], part[i], pos[i], unl[i]))
    style, pos, unl, part = style[order], pos[order], unl[order], part[order]
    edges = [np.unique(np.quantile(style[unl, j], np.linspace(0, 1, BINS + 1)[1:-1])).tolist() for j in range(style.shape[1])]
    offsets = 1 + np.cumsum([0, *[len(e) + 1 for e in edges]])
    x = np.zeros((len(style), int(offsets[-1]) + len(marks)), np.float32)
    x[:, 0] = 1
    bins = _bins(style, edges)
    for j in range(len(edges)):
        x[np.arange(len(x)), offsets[j] + bins[:, j]] = 1
    for row, at in enumerate(order):
        x[row, [offsets[-1] + k for k in found[at]]] = 1
    l2 = 4.0 / int(pos.sum())
    # A document that is positive and unlabelled is in one part, so that no text is scored by a model that saw it.
    seen, scores = [g for g in range(PARTS) if (pos & (part != g)).any() and (unl & (part != g)).any()], np.zeros(len(x))
    for g in seen:
        scores[part == g] = x[part == g] @ _apart(x[pos & (part != g)], x[unl & (part != g)], l2)
    scored = np.isin(part, seen)
    prior = class_prior(scores[pos & scored], scores[unl & scored]) if (pos & scored).any() and (unl & scored).any() else 0.5
    w = minimise(x[pos], x[unl], prior, l2 * prior)
    # The level, too, comes from texts that the scoring model has not seen.
    for g in seen:
        scores[part == g] = x[part == g] @ minimise(x[pos & (part != g)], x[unl & (part != g)], prior, l2 * prior)
    lower = level(scores[unl & scored], prior, threshold) if (pos & scored).any() and (unl & scored).any() else 0.0
    return Model(prior, float(w[0]) + lower, edges, [w[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)], {k: float(w[offsets[-1] + i]) for k, i in marks.items() if w[offsets[-1] + i]})


def _logits(model: Model, texts: pa.Array) -> np.ndarray:
    z = np.full(len(texts), model.bias)
    if model.edges and len(texts):
        weight, known = model.marks, model.marks.keys()
        rows = [(s, sum(map(weight.__getitem__, known & marks))) for s, marks in map(describe, utf8(texts))]
        bins = _bins(np.array([s for s, _ in rows]), model.edges)
        z += np.array([extra for _, extra in rows])
        for j, w in enumerate(model.style):
            z += np.array(w)[bins[:, j]]
    return z


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(_logits(model, batch.column(1))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): one row for each row of docs (doc_id, text); null and empty texts are scored as such."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_scorer(model), f"doc_id {kind}, score double")


def keep(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of docs, with all columns, whose text scores at least the threshold."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_sigmoid(_logits(model, batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def trusted(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id): ids with a label 1 in the column; other labels, null ids and null labels are left out."""
    return labels.where((F.col(column) == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
