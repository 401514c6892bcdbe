"""Quality and toxicity classifiers: positive-unlabelled models of good and of toxic texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pu
from .common import crc_fold

#: Labels of this crc32 fold are never learnt from.
FOLDS, HELD_OUT = 4, 2
QUALITY_THRESHOLD, TOXIC_THRESHOLD = 0.7, 0.3


def _fit(docs: DataFrame, labels: DataFrame, column: str, threshold: float, sizes: pu.Sizes) -> pu.Model:
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = labels.where(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    return pu.fit(texts, pu.trusted(known, column), sizes, threshold)


def _classify(docs: DataFrame, labels: DataFrame, column: str, threshold: float, sizes: pu.Sizes) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs.

    Null ids count as fold 0 and are scored; null and empty texts get the score of an empty text;
    repeated rows get equal scores. Without any label 1 every score is 0.5. An empty table gives no row.
    Columns other than doc_id and text, and doc_id and the label, are not read.
    """
    scored = pu.score(docs, _fit(docs, labels, column, threshold, sizes))
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame, sizes: pu.Sizes = pu.Sizes()) -> DataFrame:
    """Score of being good text, from texts labelled good and unlabelled texts; see _classify for edge cases."""
    return _classify(docs, labels, "quality", QUALITY_THRESHOLD, sizes)


def classify_toxicity(docs: DataFrame, labels: DataFrame, sizes: pu.Sizes = pu.Sizes()) -> DataFrame:
    """Score of being toxic, from confirmed toxic texts and unlabelled texts; see _classify for edge cases."""
    return _classify(docs, labels, "toxic", TOXIC_THRESHOLD, sizes)


def keep_quality(docs: DataFrame, labels: DataFrame, sizes: pu.Sizes = pu.Sizes()) -> DataFrame:
    """The documents that classify_quality predicts to be good, with all columns; without labels none is rejected."""
    model = _fit(docs, labels, "quality", QUALITY_THRESHOLD, sizes)
    return pu.keep(docs, model, QUALITY_THRESHOLD) if model.edges else docs
