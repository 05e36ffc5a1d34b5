"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Folders, stage, width


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    ``links`` has columns a and b.  Alternating large and small stars (each
    node hangs its larger, then its smaller neighbours on the smallest one)
    until every node hangs on one root and no root hangs on another; each round
    is two grouped minima and joins over links staged in the shared folder, and
    nothing but the answer of the test reaches the driver.
    """
    spark = links.sparkSession
    with Folders().collecting() as mine:
        links = stage(_clean(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
        while not _settled(links):
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            # large star: larger neighbours go to the smallest neighbour
            large = _clean(_with_lowest(both).filter(F.col("b") > F.col("a")).select(
                F.col("b").alias("a"), F.least("low", "a").alias("b")))
            # small star: a node and its smaller neighbours go to the smallest of them
            low = large.groupBy("a").agg(F.min("b").alias("low"))
            small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
                low.select("a", F.col("low").alias("b")))
            links = stage(_clean(small.filter("a <> b")), "links")
            mine.release(spark, links)  # the links of the round before
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _settled(links: DataFrame) -> bool:
    """Each node hangs on one other, and nothing hangs on a node that hangs: rounds would change nothing."""
    roles = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    roles = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.filter("up + down > 1 and up > 0").isEmpty()


def _with_lowest(links: DataFrame) -> DataFrame:
    """``links`` and ``low``, the smallest b of their a.

    The links of a node travel by (node, share of the neighbour), so that no
    task meets a hub whole: it has at most ``width`` shares, and only these
    come together.
    """
    dealt = links.withColumn("_share", F.pmod(F.xxhash64("b"), F.lit(width(links.sparkSession))).cast("int"))
    shares = dealt.groupBy("a", "_share").agg(F.min("b").alias("low"))
    lowest = shares.groupBy("a").agg(F.min("low").alias("low"))
    known = shares.select("a", "_share").join(lowest.hint("merge"), "a")
    return dealt.join(known.hint("merge"), ["a", "_share"]).drop("_share")


def _clean(links: DataFrame) -> DataFrame:
    return links.filter(F.col("a") > F.col("b")).distinct()
