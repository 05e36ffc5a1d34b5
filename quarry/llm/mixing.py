"""Order of a mixture of sources by Pfair scheduling of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ordered_parts, part_bases, width

OTHER = "other"


def period(spark: SparkSession, shares: list[int]) -> DataFrame:
    """One period of the schedule: (queue, k, at, before) for the k-th block of each queue.

    With ``W = sum(shares)`` slots, block j of a queue with share a is released
    at ``j * W div a`` and due at ``ceil((j + 1) * W / a)``.  Each slot goes to
    the released block that is due first (ties: smaller queue).  As the shares
    fill the period, every block meets its window, so after any slot each queue
    has had its share of slots to within less than one block, and the schedule
    repeats after W slots.  ``before`` counts the blocks of every queue in
    earlier slots of the period.  The work is W * queues steps, whatever the data.
    """
    total, n = sum(shares), len(shares)
    share = f"array({', '.join(map(str, shares))})"
    released = f"filter(sequence(0, {n - 1}), i -> s.c[i] < {share}[i] and (s.c[i] * {total}) div {share}[i] <= t)"
    due = f"named_struct('d', ((s.c[i] + 1) * {total} + {share}[i] - 1) div {share}[i], 'i', i)"
    step = f"""transform(array(array_min(transform({released}, i -> {due})).i), q -> named_struct(
        'c', transform(s.c, (x, i) -> if(i = q, x + 1, x)),
        'o', array_append(s.o, named_struct('queue', q, 'k', s.c[q], 'before', s.c))))[0]"""
    start = f"""named_struct('c', array_repeat(0, {n}),
        'o', cast(array() as array<struct<queue: int, k: int, before: array<int>>>))"""
    run = f"aggregate(sequence(0, {total - 1}), {start}, (s, t) -> {step}, s -> s.o)"
    return spark.range(1).select(F.posexplode(F.expr(run)).alias("at", "b")).select("at", "b.queue", "b.k", "b.before")


def _queue(source: Column, names: list[str]) -> Column:
    known = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)]) if names else None
    other = F.lit(len(names))
    return F.coalesce(F.try_element_at(known, source), other) if names else other


def mix(docs: DataFrame, shares: dict[str, int], block_rows: int = 8, source: str = "source", key: str = "doc_id",
        keep: list[str] | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs`` with their place in the mixture; ``keep`` names the columns to carry.

    ``shares`` gives whole-number target weights by source; ``"other"`` (1 if
    not given) is the joint weight of all sources without one, the null source
    included.  Each source (or the rest together) is a queue of its rows in
    ``key`` order, cut into blocks of ``block_rows``; the slots of the blocks
    follow ``period``.  Once a queue is used up its slots stay empty and the
    others follow on in their order, so every row has a ``position``, without
    gaps from 0.

    Adds ``queue``, ``block`` (in its queue), ``release``, ``due``, ``slot``
    and ``position``.  Equal keys are ordered by ``ties``; null keys come
    first; rows alike in all of these are interchangeable.  An empty table
    gives no rows.  A column of ``docs`` that is called like an added one is
    replaced by it; others come back as they are, whatever their names.
    """
    spark = docs.sparkSession
    weights = {k: v for k, v in shares.items() if k != OTHER}
    names, parts_of = list(weights), [*weights.values(), shares.get(OTHER, 1)]
    if min(parts_of) < 1:
        raise ValueError("target weights are whole numbers from 1")
    total = sum(parts_of)
    added = ("queue", "block", "release", "due", "slot", "position")
    columns = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    order = [F.col(c).alias(f"_order{i}") for i, c in enumerate((key, *ties))]
    # The columns travel as one value, so none meets a column of the schedule.
    rows = docs.select(F.struct(*columns).alias("row"), *order, _queue(F.col(source), names).alias("queue"))
    parts = ordered_parts(rows, "queue", *[f"_order{i}" for i in range(len(order))], purpose="mix")
    sizes = dict(parts.groupBy("queue").count().collect())  # one number for each given weight
    counts = ", ".join(f"{sizes.get(i, 0)}L" for i in range(len(parts_of)))
    share = f"array({', '.join(f'{a}L' for a in parts_of)})"
    bases = part_bases(parts, F.lit(1), "queue")
    ranked = parts.join(F.broadcast(bases), ["_part", "queue"]).withColumn("_rank", F.expr("_base + _at - _first"))
    blocks = ranked.withColumn("block", F.expr(f"_rank div {block_rows}")).withColumn(
        "k", F.expr(f"cast(block % {share}[queue] as int)"))
    placed = blocks.join(F.broadcast(period(spark, parts_of)), ["queue", "k"]).withColumn(
        "_round", F.expr(f"block div {share}[queue]"))
    earlier = f"""aggregate(zip_with(zip_with(before, {share}, (b, a) -> {block_rows} * (_round * a + b)),
        array({counts}), (x, n) -> least(x, n)), 0L, (x, y) -> x + y)"""
    return placed.select(
        *[F.col("row")[c].alias(c) for c in columns], "queue", "block",
        F.expr(f"(block * {total}) div {share}[queue]").alias("release"),
        F.expr(f"((block + 1) * {total} + {share}[queue] - 1) div {share}[queue]").alias("due"),
        F.expr(f"_round * {total} + at").alias("slot"),
        F.expr(f"{earlier} + _rank % {block_rows}").alias("position"))


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows sorted by ``position`` over the whole table, so that files written in turn hold the mixture's order."""
    return mixed.repartitionByRange(width(mixed.sparkSession), "position").sortWithinPartitions("position")
