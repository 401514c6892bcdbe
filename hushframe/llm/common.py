"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every node sees: spark.checkpoint.dir, or a temporary one where a local session has none."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    master = context.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    folder = tempfile.mkdtemp(prefix="hushframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(f"file://{folder}")
    return context.getCheckpointDir()


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that later steps do not depend on what made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that may be broadcast; a table of more is joined by a shuffle.
FEW_ROWS = 200_000


def if_few(rows: DataFrame, count: int) -> DataFrame:
    """rows, of which there are count, to be broadcast only if they are few."""
    return F.broadcast(rows) if count <= FEW_ROWS else rows


def word_array(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell rows apart by id and text, defined for nulls too; rows alike in both share it."""
    shown = F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(shown, F.lit("\n"), F.coalesce(text, F.lit("")))))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column as UTF-8, empty for null; few are Python objects at a time."""
    raw = column.cast(pa.binary())
    for i in range(0, len(raw), 64):
        for value in raw.slice(i, 64).to_pylist():
            yield value or b""
