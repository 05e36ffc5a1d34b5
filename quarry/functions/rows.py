"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array: Column | str, value: str, pos: str | None = None, keep=("*",)) -> DataFrame:
    """One row per array element, with its position when ``pos`` is given.

    The outer form is used and its empty rows dropped: for the inner form the
    optimizer adds a filter on the array's size below the explode, which
    evaluates a computed array a second time, and before any repartitioning.
    """
    at = pos or "_pos"
    out = df.select(*keep, F.posexplode_outer(array).alias(at, value)).filter(F.col(at).isNotNull())
    return out if pos else out.drop(at)
