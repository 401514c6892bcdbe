"""What a sink has committed, kept beside its data, so that a batch that comes again changes nothing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Commits:
    """Files named by batch in a folder, each with what stands after that batch. A file is written beside and then renamed,
    so that a batch is committed whole or not at all; the last file holds.

    One query writes to a folder at a time, as one query has a checkpoint. The folder must be of a file system whose rename
    is atomic.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        jvm = spark._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self.folder = self._path(folder)
        self._fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        if not self._fs.exists(self.folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self.folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def last(self) -> dict | None:
        """What stands after the last batch, with its number as batch; None before the first."""
        known = self.batches()
        if not known:
            return None
        stream = self._fs.open(self._path(self.folder, str(known[-1])))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"batch": known[-1]}

    def commit(self, batch: int, state: dict) -> None:
        target, beside = self._path(self.folder, str(batch)), self._path(self.folder, f".{batch}.tmp")
        self._fs.mkdirs(self.folder)
        stream = self._fs.create(beside, True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        if self._fs.exists(target) or not self._fs.rename(beside, target):
            raise RuntimeError(f"batch {batch} is committed already")


class ChangedSnapshots:
    """A foreachBatch function that keeps a snapshot only where it differs from the one kept before.

    The rows of a batch go to a folder of their own, named by the batch, before the batch is committed with its digest: a
    batch that fails in between writes the same folder anew, and one that was committed is passed over. What is remembered
    is the digest, the number of rows and the folder; it lies beside the data and outlives the driver.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.commits = Commits(spark, f"{path}/commits")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        last = self.commits.last()
        if last is not None and batch_id <= last["batch"]:
            return
        row = batch.select(F.xxhash64(*sorted(batch.columns)).cast("decimal(20,0)").alias("h")).agg(F.sum("h").cast("string").alias("s"), F.count("*").alias("n")).first()
        digest = [row["s"], row["n"]]
        if last is not None and last["digest"] == digest:
            self.commits.commit(batch_id, {"digest": digest, "data": last["data"]})
            return
        self.write(batch, f"{self.path}/data/batch-{batch_id}")
        self.commits.commit(batch_id, {"digest": digest, "data": f"batch-{batch_id}"})

    def write(self, batch: DataFrame, folder: str) -> None:
        batch.write.mode("overwrite").parquet(folder)

    def read(self) -> DataFrame | None:
        """The snapshot kept last; None before the first."""
        last = self.commits.last()
        return self.spark.read.parquet(f"{self.path}/data/{last['data']}") if last else None
