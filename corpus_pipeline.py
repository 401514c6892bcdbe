"""A corpus pipeline: quality, near duplicates, benchmark passages, secrets, then a mix of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import decontaminate, mixing, pu_ops, secret_scan, simhash
from hushframe.llm.common import cut, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored as texts without words; rows alike
    get one verdict; null ids have no label; an empty table gives no row; all columns stay, whatever their names."""
    return pu_ops.keep_quality(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates. Null and empty texts are alike, so one of them stays; an empty
    table gives no row; all columns stay, whatever their names."""
    return simhash.keep_one_per_group(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Null and empty texts have none and stay, as do repeated rows; an empty table
    of either kind takes nothing away; all columns stay, whatever their names."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked. n_chars follows the text; null and empty texts stay as they
    are, repeated rows too; an empty table gives no row; all columns stay, whatever their names."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies and of words.

    Null and empty texts have no words: they stay with the copies that all texts of their source get, and take 0 words. Rows
    alike are taken together; an empty table gives no row. The
    results are size, copies and taken; where docs has a column of such a name, in any case, it stays and the result gets
    the prefix mix_, as often as it takes.
    """
    mixed = mixing.mix(docs).where("__copies > 0")
    held, named = {c.lower() for c in docs.columns}, []
    for result in ("size", "copies", "taken"):
        name = result
        while name in held:
            name = f"mix_{name}"
        held.add(name)
        named.append(F.col(f"__{result}").alias(name))
    return mixed.select(*[mixed[f"`{c}`"] for c in docs.columns], *named)


STAGES = [
    ("quality", keep_good),
    ("near duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark),
    ("secrets", hide_secrets),
    ("mix", mix_sources),
]

#: Learnt models and fingerprints have no SQL; tests compare the stages with plain ones instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
