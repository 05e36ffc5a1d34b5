"""Staged tables, global positions and Arrow helpers that the operators share."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import shared_dir

_OWNER: ContextVar[Folders | None] = ContextVar("owner", default=None)


class Folders:
    """The folders that are staged while this owner collects them, and nobody else's.

    Folders staged outside any owner are never deleted here.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []

    @contextmanager
    def collecting(self):
        """Within, this thread's staged folders are this owner's; what it still has at the end goes to the owner around it."""
        outer, token = _OWNER.get(), _OWNER.set(self)
        try:
            yield self
        finally:
            _OWNER.reset(token)
            if outer is not None and outer is not self:
                outer.paths.extend(self.paths)
                self.paths = []

    def release(self, spark: SparkSession, needed: DataFrame | None = None) -> None:
        """Delete this owner's folders, but for those that ``needed`` reads; call it when nothing else is to read them."""
        files = needed.inputFiles() if needed is not None else []
        inside = lambda path: any(path.split("://")[-1].split(":")[-1].lstrip("/") in f for f in files)
        mine, self.paths = self.paths, []
        for path in mine:
            if inside(path):
                self.paths.append(path)
            else:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    if spark.conf.get("spark.checkpoint.dir", None) or not spark.sparkContext.master.startswith("local["):
        path = shared_dir(spark, purpose)
    else:
        path = tempfile.mkdtemp(prefix=f"quarry-{purpose}-") + "/table"
    owner = _OWNER.get()
    if owner is not None:
        owner.paths.append(path)
    return path


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a table that outlives lost executors."""
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, from the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_parts(df: DataFrame, *order: str, purpose: str = "ordered") -> DataFrame:
    """``df`` sorted over the whole table by ``order`` and staged.

    ``_part`` numbers the ranges in order and ``_at`` the rows inside each from
    0.  A heavy key spreads over several ranges when ``order`` goes on after it
    with columns that differ.
    """
    dealt = df.repartitionByRange(width(df.sparkSession), *order).sortWithinPartitions(*order)
    numbered = dealt.withColumn("_id", F.monotonically_increasing_id())
    return stage(numbered.select("*", F.shiftright("_id", 33).alias("_part"),
                                 F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")).drop("_id"), purpose)


def part_bases(parts: DataFrame, value: Column, *keys: str) -> DataFrame:
    """For each part (and key): its first row, and the sum of ``value`` over the parts before it (of that key).

    One row for each part and key that meet, so it grows with the number of
    partitions and keys and not with the rows.
    """
    totals = parts.groupBy("_part", *keys).agg(F.sum(value).alias("_total"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", *keys, "_first", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))


def rows_by_id(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row``, a struct of the columns of ``docs``, and ``node``, which no two rows with an id share.

    The node is the id where none repeats, else the place of the row in the
    order of (id, size of text); of rows with equal id and text one is left.
    Rows without id have no node.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("node"))
    if rows.filter("node is not null").groupBy("node").count().filter("count > 1").isEmpty():
        return rows
    column = F.col("row")[text]
    one = Window.partitionBy("node", column).orderBy(*[F.col("row")[c].cast("string") for c in docs.columns if c != text])
    kept = rows.filter("node is not null").withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").drop("_nth")
    kept = kept.withColumn("_size", F.octet_length(column)).withColumn("_mark", F.xxhash64(column))
    placed = ordered_parts(kept, "node", "_size", "_mark", purpose="rows")
    return placed.select("row", (F.shiftleft("_part", 33) + F.col("_at")).alias("node")).unionByName(rows.filter("node is null"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (null: empty) and the offsets of its values."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def slices(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Runs of values of at most ``limit`` bytes together (a longer value stands alone)."""
    out, low, n = [], 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        out.append((low, min(high, n)))
        low = out[-1][1]
    return out
