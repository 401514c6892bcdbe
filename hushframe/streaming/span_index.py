"""An index of intervals that have been processed: it lies on disk, and micro-batches merge into it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import interval_difference, interval_union
from .commits import Commits


class SpanIndex:
    """The union of half-open intervals (key, lo, hi), in buckets of keys.

    A batch reads and writes only the buckets that its keys fall in: their new version goes to folders named by the batch,
    and the commit says which folder each bucket has from then on. A batch that is merged again, after a failure or a
    restart, changes nothing. The key is a string or a whole number, as is; lo and hi are long.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str = "long", buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = f"key {key_type}, lo long, hi long"
        self.commits = Commits(spark, f"{path}/commits")

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def _of(self, folders: dict[str, str]) -> DataFrame:
        """What the folders hold of their buckets."""
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}/bucket={bucket}") for bucket, folder in sorted(folders.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch of intervals (key, lo, hi); a foreachBatch function. Empty intervals and nulls add nothing."""
        last = self.commits.last() or {"batch": -1, "folders": {}}
        if batch_id <= last["batch"]:
            return
        new = batch.selectExpr("key", "cast(lo as long) AS lo", "cast(hi as long) AS hi").where("key is not null and hi > lo")
        touched = [str(r[0]) for r in new.select(self._bucket()).distinct().collect()]  # as many as buckets at most
        folders = dict(last["folders"])
        if touched:
            old = self._of({b: folders[b] for b in touched if b in folders})
            merged = interval_union(old.unionByName(new), "key", "lo", "hi").withColumn("bucket", self._bucket())
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch-{batch_id}")
            folders |= dict.fromkeys(touched, f"batch-{batch_id}")
        self.commits.commit(batch_id, {"folders": folders})

    def read(self) -> DataFrame:
        """(key, lo, hi): all that has been processed."""
        return self._of((self.commits.last() or {"folders": {}})["folders"])

    def missing(self, wanted: DataFrame) -> DataFrame:
        """(key, lo, hi): what of wanted (key, lo, hi) the index does not hold yet."""
        return interval_difference(wanted, self.read(), "key", "lo", "hi")
