"""As-of joins: each row meets the version that is valid at its time, or the first row at or after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefixes import PART, last_value, with_part


def valid_at(rows: DataFrame, versions: DataFrame, key: str, time: str, since: str, parts: int = 16) -> DataFrame:
    """rows with version: struct of all columns of the version of their key with the greatest since at or before their time, else null.

    time and since are numbers. Of versions with one since, the one whose columns are greatest is valid. Both tables go
    through one sort of a key's part, versions first at equal times, so that no row meets more than one version and no key
    more than its share of a task. Rows with a null key or time, and versions with either null, meet nothing; rows stay as
    they are, repeated ones each; a column version of rows is replaced.
    """
    kept = [c for c in rows.columns if c != "version"]
    asked = rows.select(F.col(key).alias("__key"), F.col(time).alias("__at"), F.lit(1).alias("__side"), F.struct(*kept).alias("__row"))
    state = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull())
    state = state.select(F.col(key).alias("__key"), F.col(since).alias("__at"), F.lit(0).alias("__side"), F.struct(*[F.col(c) for c in versions.columns]).alias("__version"))
    both = with_part(asked.unionByName(state, allowMissingColumns=True), "__at", parts)
    # A row at a version's time lies in its part; ties of versions go by their columns, nulls first.
    order = [F.col("__at").asc_nulls_first(), F.col("__side"), F.col("__version").asc_nulls_first()]
    found = last_value(both, ["__key"], order, F.col("__version"), "version", F.struct("__at", "__side", "__version"))
    usable = F.col("__key").isNotNull() & F.col("__at").isNotNull()
    return found.where("__side = 1").select("__row.*", F.when(usable, F.col("version")).alias("version"))


def following(points: DataFrame, rows: DataFrame, key: str, time: str, order: str, parts: int = 16) -> DataFrame:
    """points (key, time, ...) with found: struct<time, order> of the first of rows (key, time, order) of their key at or after their time, else null."""
    kept = [c for c in points.columns if c != "found"]
    asked = points.select(F.col(key).alias("__key"), (-F.col(time)).alias("__at"), F.lit(1).alias("__side"), F.struct(*kept).alias("__row"))
    goal = F.struct(F.col(time).alias("time"), F.col(order).alias("order"))
    goals = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("__key"), (-F.col(time)).alias("__at"), F.lit(0).alias("__side"), goal.alias("__goal"))
    both = with_part(asked.unionByName(goals, allowMissingColumns=True), "__at", parts)
    # Backwards in time; of goals at one time the one that is first in order comes last.
    turned = F.struct("__at", "__side", (-F.col("__goal.order")).alias("o"))
    found = last_value(both, ["__key"], [turned], F.col("__goal"), "found", turned)
    usable = F.col("__key").isNotNull() & F.col("__at").isNotNull()
    return found.where("__side = 1").select("__row.*", F.when(usable, F.col("found")).alias("found"))


__all__ = ["PART", "following", "valid_at"]
