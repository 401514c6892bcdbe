"""Connected components of a graph that no single node could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that has an edge to another; nodes of one component share their root.

    Each round every node goes over to the neighbour (or itself) that comes first in a scrambled order,
    and edges are renamed accordingly; in that order long chains shrink by a share in each round.
    Self loops and repeated edges do no harm; no edges give no rows.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct()
    rest, steps = cut(pairs, "edges"), []
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        best = F.min(F.struct(F.xxhash64("b").alias("p"), F.col("b").alias("v"))).alias("m")
        own = F.struct(F.xxhash64("a").alias("p"), F.col("a").alias("v"))
        step = cut(both.groupBy("a").agg(best).select(F.col("a").alias("node"), F.least(F.col("m"), own)["v"].alias("to")), "step")
        steps.append(step)
        by_a, by_b = step.toDF("a", "to_a"), step.toDF("b", "to_b")
        moved = rest.join(by_a, "a").join(by_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        rest = cut(moved.where("a <> b").distinct(), "edges")
    if not steps:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0].toDF("node", "root")
    for step in steps[1:]:
        onward = step.toDF("root", "to")
        found = found.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return found
