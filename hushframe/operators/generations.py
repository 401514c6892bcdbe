"""Generations of a page: snapshots of blocks that differ in many places begin a new one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def generations(blocks: DataFrame, key: str, snapshot: str, block: str, value: str, share: float = 0.35, hot_after: int = 3) -> DataFrame:
    """(key, snapshot, n_blocks, n_changed, n_hot, share, generation) for each snapshot of each key.

    blocks: one row for each block of a snapshot; of rows with one key, snapshot and block the greatest value counts. A block
    has changed where its value differs from that of the snapshot before, or only one of both has it. A block that changed
    hot_after times running before a snapshot is hot there and counts for nothing. generation counts the snapshots, from 0,
    at which the changed share of the blocks that are not hot is at least share; the first has no change. Neighbouring
    snapshots meet by a full outer join on the block, so that no snapshot is gathered; only its counts are put in order.
    Null keys and snapshots are left out; a null block is a block, a null value a value. No rows give none.
    """
    rows = blocks.select(F.col(key).alias("k"), F.col(snapshot).alias("s"), F.col(block).alias("b"), F.col(value).alias("v"))
    rows = rows.where("k is not null and s is not null").groupBy("k", "s", "b").agg(F.max("v").alias("v"))
    numbered = rows.select("k", "s").distinct().withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("s")))
    now = rows.join(numbered, ["k", "s"]).select("k", "n", "b", "v")
    last = numbered.groupBy("k").agg(F.max("n").alias("last"))
    was = now.join(last, "k").where("n < last").select(F.col("k").alias("k0"), (F.col("n") + 1).alias("n0"), F.col("b").alias("b0"), F.col("v").alias("v0"))
    same_place = reduce(lambda a, c: a & c, [F.col("k") == F.col("k0"), F.col("n") == F.col("n0"), F.col("b").eqNullSafe(F.col("b0"))])
    kept = F.col("k").isNotNull() & F.col("k0").isNotNull() & F.col("v").eqNullSafe(F.col("v0"))
    met = now.join(was, same_place, "full").select(F.coalesce("k", "k0").alias("k"), F.coalesce("n", "n0").alias("n"), F.coalesce("b", "b0").alias("b"), (~kept).alias("differs"))
    met = met.withColumn("changed", F.col("differs") & (F.col("n") > 1))
    running = Window.partitionBy("k", "b").orderBy("n").rangeBetween(-hot_after, -1)
    met = met.withColumn("hot", F.coalesce(F.sum(F.col("changed").cast("int")).over(running) >= hot_after, F.lit(False)))
    counts = met.groupBy("k", "n").agg(F.count_if(~F.col("hot")).alias("n_blocks"), F.count_if(F.col("changed") & ~F.col("hot")).alias("n_changed"), F.count_if("hot").alias("n_hot"))
    part = F.when(F.col("n_blocks") > 0, F.col("n_changed") / F.col("n_blocks")).otherwise(0.0)
    resets = F.sum(((F.col("n") > 1) & (F.col("share") >= share)).cast("long")).over(Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("share", part).withColumn("generation", resets).join(numbered, ["k", "n"])
    return found.select(F.col("k").alias(key), F.col("s").alias(snapshot), "n_blocks", "n_changed", "n_hot", "share", "generation")
