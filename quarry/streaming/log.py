"""Append-only batch log: the sink of the streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_dir
from quarry.sources.versions import Manifest


class BatchLog:
    """One folder per micro-batch.

    Writing a batch again replaces its folder, so a retried batch leaves no
    double rows.  Tables that are upserted keep their rows here and are merged
    when read, with ordinary aggregates.
    """

    def __init__(self, spark: SparkSession, purpose: str, path: str | None = None):
        self.spark = spark
        self.path = path or shared_dir(spark, purpose)
        self.checkpoint = f"{self.path}/_checkpoint"
        self.data = f"{self.path}/data"

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.data}/batch={batch_id}")

    def run(self, stream: DataFrame, mode: str = "append",
            prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> "BatchLog":
        """Process everything that has arrived, then stop."""
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", self.checkpoint)
                 .foreachBatch(lambda df, batch_id: self.write(prepare(df), batch_id))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.data)

    def latest(self, keys: list[str]) -> DataFrame:
        """Rows of each key's last batch."""
        rows = self.read()
        last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
        return rows.join(last, [*keys, "batch"], "left_semi").drop("batch")


class MergedLog(BatchLog):
    """A batch log that keeps few folders: neighbouring batches are merged into segments.

    ``condense`` makes fewer rows of a run of rows and leaves what any later
    merge gives unchanged.  After each batch the newest folders are merged while
    there are more than ``folders`` of them, or while one covers no more batches
    than those after it together, so a row is rewritten about as often as the
    number of batches can be halved as long as ``folders`` allows that.  A
    segment counts from the moment the manifest names it; batches that come
    again after their segment was committed change nothing.
    """

    def __init__(self, spark: SparkSession, purpose: str, condense: Callable[[DataFrame], DataFrame],
                 path: str | None = None, folders: int = 3):
        super().__init__(spark, purpose, path)
        self.condense, self.folders = condense, folders
        self.manifest = Manifest(spark, f"{self.path}/manifest")

    def segments(self) -> list[tuple[str, int, int]]:
        """(folder, first batch, last batch) of all folders that readers read, in order."""
        merged = [tuple(s) for s in self.manifest.read()]
        last = max([s[2] for s in merged], default=-1)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.data)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        fresh = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
        return merged + [(f"data/batch={b}", b, b) for b in fresh if b > last]

    def write(self, df: DataFrame, batch_id: int) -> None:
        super().write(df, batch_id)
        parts = self.segments()
        span = lambda s: s[2] - s[1] + 1
        first = len(parts) - 1
        while first > 0 and (first + 1 > self.folders or span(parts[first - 1]) <= sum(map(span, parts[first:]))):
            first -= 1
        if first < len(parts) - 1:
            low, high = parts[first][1], parts[-1][2]
            folder = f"merged/{low}-{high}-{uuid.uuid4().hex}"
            self.condense(self._rows(parts[first:])).write.parquet(f"{self.path}/{folder}")
            self.manifest.commit([*parts[:first], (folder, low, high)])

    def _rows(self, parts: list[tuple[str, int, int]]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{p[0]}" for p in parts])

    def read(self) -> DataFrame:
        return self._rows(self.segments())


def arrivals(df: DataFrame, slice_no: Column, slices: int) -> DataFrame:
    """A table as a stream of about ``slices`` micro-batches: rows arrive in the order of their slice number."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, "arrivals")
    for i in range(slices):
        df.filter(slice_no == i).write.mode("append").parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files // slices)).parquet(path))
