"""Rules and settings at rest, and tables of discovered values, windows and words."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Rule

# The settings and their defaults.
SETTINGS = {
    "Style": "Solid", "Hotkey": "Ctrl+Shift+PrintScreen", "StartWithWindows": False, "StartMinimized": True, "ProtectClipboardScreenshots": True,
    "ShowToastAfterRedaction": True, "Theme": "System", "LiveProtection": False, "CloseToTray": True, "BoxColor": "#111111",
}
NETWORK_LINE = r"(?m)^\s*SSID\s*:\s*(.+?)\s*$"
# Fixed values end here.


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target, jvm.org.apache.hadoop.fs.Path


def _replace(spark: SparkSession, row: DataFrame, path: str, name: str) -> None:
    """Put one row of text into the file name of a folder: written beside it, then renamed over the old file in one step, so
    that a reader or a crash meets the old content or the new one."""
    fs, target, to_path = _filesystem(spark, path)
    row.coalesce(1).write.mode("overwrite").text(path + ".tmp")
    parts = [s.getPath() for s in fs.listStatus(to_path(path + ".tmp")) if s.getPath().getName().startswith("part-")]
    fs.mkdirs(target)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context.rename(fs.makeQualified(parts[0]), fs.makeQualified(to_path(target, name)), options)
    fs.delete(to_path(path + ".tmp"), True)


def save_rules(spark: SparkSession, rules: Iterable[Rule], path: str, key: str) -> None:
    """Write the rules as encrypted JSON, in place of those saved before.

    key: 16, 24 or 32 characters. The file is as safe as the key, which belongs in a secret store.
    """
    text = json.dumps([asdict(r) for r in rules])
    row = spark.createDataFrame([(text, key)], "t string, k string").select(F.hex(F.aes_encrypt("t", "k", F.lit("GCM"))).alias("value"))
    _replace(spark, row, path, "rules.txt")


def load_rules(spark: SparkSession, path: str, key: str) -> list[Rule]:
    """The saved rules; none if there is no file. A file that cannot be read is kept as .unreadable and gives none."""
    fs, target, to_path = _filesystem(spark, path)
    if not fs.exists(target):
        return []
    read = spark.read.text(path).select(F.try_aes_decrypt(F.unhex("value"), F.lit(key), F.lit("GCM")).cast("string").alias("t"))
    try:
        rows = [r["t"] for r in read.collect()]
        known = {f.name for f in fields(Rule)}
        return [Rule(**{k: v for k, v in r.items() if k in known}) for t in rows for r in json.loads(t)]
    except (TypeError, ValueError):  # a wrong key, a damaged file or other content
        backup = to_path(path + ".unreadable")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, target, fs, backup, False, True, spark._jsc.hadoopConfiguration())
        return []


def load_settings(spark: SparkSession, path: str) -> dict:
    """Settings from JSON with defaults for what is missing or cannot be read."""
    fs, target, _ = _filesystem(spark, path)
    if not fs.exists(target):
        return dict(SETTINGS)
    names = {bool: "boolean", str: "string"}
    schema = ", ".join(f"{k} {names[type(v)]}" for k, v in SETTINGS.items())
    row = spark.read.schema(schema).option("multiLine", True).json(path).first()
    found = row.asDict() if row else {}
    return {k: v if found.get(k) is None else found[k] for k, v in SETTINGS.items()}


def save_settings(spark: SparkSession, settings: dict, path: str) -> None:
    _replace(spark, spark.createDataFrame([(json.dumps(settings),)], "value string"), path, "settings.json")


def network_names(output: Column) -> Column:
    """The network names in the text that a listing of networks gives; hardware addresses are not among them."""
    return F.regexp_extract_all(output, F.lit(NETWORK_LINE), F.lit(1))


def word_rows(docs: DataFrame, per_line: int = 12, char_width: float = 8.0, height: float = 14.0, pitch: float = 20.0) -> DataFrame:
    """(doc_id, words): of each document, an array of (line, word_ix, text, x, y, width, height) as a reader of print might give
    them, in lines of per_line words; in place, without a shuffle."""
    split = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")

    def box(text, at):
        line = F.floor(at / per_line).cast("int")
        before = F.aggregate(F.slice("split", at - at % per_line + 1, at % per_line), F.lit(0).cast("long"), lambda n, w: n + F.length(w) + 1)
        return F.struct(line.alias("line"), (at % per_line).alias("word_ix"), text.alias("text"), (before * char_width).alias("x"), (line * pitch).alias("y"), (F.length(text) * char_width).alias("width"), F.lit(height).alias("height"))

    return docs.select("doc_id", F.explode(F.array(split)).alias("split")).select("doc_id", F.explode(F.array(F.transform("split", box))).alias("words"))


def words(docs: DataFrame, per_line: int = 12, char_width: float = 8.0, height: float = 14.0, pitch: float = 20.0) -> DataFrame:
    """(doc_id, line, word_ix, text, x, y, width, height): the words of word_rows, a row each."""
    return word_rows(docs, per_line, char_width, height, pitch).select("doc_id", F.inline("words"))
