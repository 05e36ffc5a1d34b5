"""Named operators with descriptions, looked up by name (U4)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quarry.session import spread


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    operators: str
    sql: str | None = None
    description: str = ""
    parameters: dict[str, str] = field(default_factory=dict)


class Catalog:
    """Entries by name; registering a name again replaces the entry."""

    def __init__(self) -> None:
        self._entries: dict[str, Entry] = {}

    def add(self, entry: Entry) -> None:
        self._entries[entry.name] = entry

    def get(self, name: str) -> Entry | None:
        return self._entries.get(name)

    def names(self) -> list[str]:
        return list(self._entries)

    def __iter__(self):
        return iter(self._entries.values())


CATALOG = Catalog()


def query(operators: str, sql: str | None = None, name: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its own name."""

    def wrap(fn):
        CATALOG.add(Entry(name or fn.__name__, fn, operators, sql, (fn.__doc__ or "").strip(),
                          {"spark": "SparkSession", "sf_dir": "folder of the parquet tables"}))
        return fn

    return wrap


# Tables whose rows are worked on one by one (parsed, tokenised, chunked).
ROW_WISE = ("documents", "pages", "conversations", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ROW_WISE else df
