"""Top-k, samples and ordered grouping shared by the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank.

    The rank limit is pushed below the shuffle, so a hot key sends at most
    ``k`` rows per task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def rank_all(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def sample_rows(df: DataFrame, n: int, key: str, seed: str = "0") -> DataFrame:
    """Reproducible uniform sample of ``n`` rows."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), F.col(key)).limit(n)


def sample_chunks(df: DataFrame, n: int, key: str, content: str, min_chars: int = 100, seed: str = "0") -> DataFrame:
    """Sample of ``n`` chunks of at least ``min_chars`` characters (L4)."""
    return sample_rows(df.filter(F.length(content) >= min_chars), n, key, seed)


def extreme_cases(df: DataFrame, metric: str, n: int = 5, best: bool = False, key: str = "query_id") -> DataFrame:
    """Worst (or best) ``n`` cases of a metric in a long (case, metric, value) table (L2)."""
    value = F.col("value").desc() if best else F.col("value").asc()
    return df.filter(F.col("metric") == metric).orderBy(value, F.col(key)).limit(n)


def ordered_texts(position: Column, text: Column) -> Column:
    """Texts of a bounded group, ordered by position."""
    return F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), text.alias("t")))), lambda s: s["t"])


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key."""
    return top_k(df, keys, order, 1, "_first").drop("_first")
