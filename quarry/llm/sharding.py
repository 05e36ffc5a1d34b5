"""Contiguous shards of nearly equal bytes from global prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import ordered_parts, part_bases


def byte_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The shard and slot of each row of ``docs``, cut from the rows in ``key`` order.

    A row's size is the UTF-8 length of its text (null: none) plus 1.  The rows
    are sorted into ranges; sizes are summed inside each range, and the totals
    of the ranges before it are added, so no task sees more than its range.
    The whole is cut at equal byte targets: a row goes to the shard in which
    its middle byte falls.  Shards are runs of the order whose sizes differ
    from the target by less than the two rows at their ends; a row larger than
    a target can leave shards empty.  ``slot`` counts each shard's rows from 0.

    Equal keys are ordered by size and checksum, null keys come first, rows
    alike in all three are interchangeable, and every row is returned.  The
    unit is the row: copies are placed by their keys, not kept together.  An
    empty table gives no rows.  Other columns are not read.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(content).cast("long") + 1).alias("size"),
                       F.crc32(content).alias("text_crc32"))
    parts = ordered_parts(rows, key, "size", "text_crc32", purpose="shards")
    total = parts.agg(F.sum("size")).first()[0] or 1
    bytes_before = part_bases(parts, F.col("size")).select("_part", F.col("_base").alias("_bytes"))
    rows_before = part_bases(parts, F.lit(1)).select("_part", F.col("_base").alias("_rows"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        parts.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(F.broadcast(bytes_before), "_part").join(F.broadcast(rows_before), "_part")
        .select(key, "size", "text_crc32", (F.col("_rows") + F.col("_at")).alias("_rank"),
                F.expr(f"((2 * (_bytes + _in) + size) * {shards}) div {2 * total}").cast("int").alias("shard"))
    )
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_start"))  # at most ``shards`` rows
    return placed.join(F.broadcast(first), "shard").select(
        key, "size", "text_crc32", "shard", (F.col("_rank") - F.col("_start")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the rows of ``docs`` below ``path/shard=N``; keys must be unique and not null."""
    docs.join(placed.select(key, "shard", "slot"), key).repartitionByRange("shard", "slot") \
        .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
