"""By how much one sequence is another, moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAR, BEST = 4, 40


def shifts(before: DataFrame, after: DataFrame, key: str, position: str, value: str, expected: DataFrame | None = None, least_overlap: float = 0.5) -> DataFrame:
    """(key, shift, error, still_error, moved): the row at a position of before stands shift positions on in after.

    before, after: key, position (whole), value (a number); a position of a key holds one row, else the greatest. Rows whose
    value is the only one of its kind on both sides vote for their offset. Candidates are offsets with no fewer votes than
    their neighbours, the BEST with the most; those within NEAR of what is expected (a table key, shift; 0 where it has none);
    and 0. The error of an offset is the mean difference of the rows it lays on each other, which must be least_overlap of
    the shorter side. Of offsets within 1 % and 0.01 of the least error the nearest to the expected one is the shift, then
    the smaller. moved: its error is less than half of that of no shift. A key with rows on one side only, or without any
    candidate that overlaps enough, has no row. Rows with a null are left out.
    """
    tidy = lambda d: d.select(F.col(key).alias("k"), F.col(position).cast("long").alias("p"), F.col(value).cast("double").alias("v")).dropna().groupBy("k", "p").agg(F.max("v").alias("v"))
    a, b = tidy(before), tidy(after)
    alone = lambda d, name: d.groupBy("k", "v").agg(F.count("*").alias("n"), F.min("p").alias(name)).where("n = 1").drop("n")
    votes = alone(a, "p").join(alone(b, "q"), ["k", "v"]).select("k", (F.col("q") - F.col("p")).alias("o")).groupBy("k", "o").agg(F.count("*").alias("votes"))
    near = Window.partitionBy("k").orderBy("o")
    beside = lambda f: F.when(F.abs(f("o").over(near) - F.col("o")) == 1, f("votes").over(near)).otherwise(0)
    sizes = a.groupBy("k").agg(F.count("*").alias("n_a")).join(b.groupBy("k").agg(F.count("*").alias("n_b")), "k")
    if expected is None:
        wanted = sizes.select("k", "n_a", "n_b", F.lit(0).cast("long").alias("e"))
    else:
        told = expected.select(F.col(key).alias("k"), F.col("shift").cast("long").alias("e"))
        wanted = sizes.join(told, "k", "left").select("k", "n_a", "n_b", F.coalesce("e", F.lit(0)).alias("e"))
    peaks = votes.where("votes > 0").withColumn("low", beside(F.lag)).withColumn("high", beside(F.lead)).where("votes >= low and votes >= high").join(wanted.select("k", "e"), "k")
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("votes"), F.abs(F.col("o") - F.col("e")), "o"))
    peaks = peaks.withColumn("rank", rank).where(F.col("rank") <= BEST).select("k", "o")
    around = wanted.select("k", F.explode(F.concat(F.sequence(F.col("e") - NEAR, F.col("e") + NEAR), F.array(F.lit(0).cast("long")))).alias("o"))
    candidates = peaks.unionByName(around).distinct().groupBy("k").agg(F.collect_list("o").alias("offsets"))
    laid = a.join(candidates, "k").select("k", "v", F.explode("offsets").alias("o"), "p").select("k", "o", "v", (F.col("p") + F.col("o")).alias("q"))
    pairs = laid.join(b.select("k", F.col("p").alias("q"), F.col("v").alias("w")), ["k", "q"])
    errors = pairs.groupBy("k", "o").agg(F.avg(F.abs(F.col("v") - F.col("w"))).alias("error"), F.count("*").alias("n")).join(wanted, "k")
    errors = errors.withColumn("enough", F.col("n") >= least_overlap * F.least("n_a", "n_b"))
    by_key = errors.groupBy("k").agg(F.min(F.when(F.col("enough"), F.col("error"))).alias("least"), F.max(F.when(F.col("o") == 0, F.col("error"))).alias("still_error"))
    ties = errors.where("enough").join(by_key, "k").where(F.col("error") <= F.col("least") * 1.01 + 0.01)
    best = ties.groupBy("k").agg(F.min(F.struct(F.abs(F.col("o") - F.col("e")).alias("far"), "o", "error", "still_error")).alias("m"))
    moved = (F.col("m.o") != 0) & F.coalesce(F.col("m.error") < 0.5 * F.col("m.still_error"), F.lit(True))
    return best.select(F.col("k").alias(key), F.col("m.o").alias("shift"), F.col("m.error").alias("error"), F.col("m.still_error").alias("still_error"), moved.alias("moved"))
