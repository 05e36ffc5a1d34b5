"""Tables whose readers see one whole version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import cut_lineage, fits, passing, sweep


class Manifest:
    """Numbered lists of a table's folders.

    A list is written beside its final name and renamed there, so it is there
    whole or not at all, and of two writers of one number the second fails.
    Readers follow the highest number.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def number(self) -> int:
        """Number of the current list; 0 before the first."""
        at, fs = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max([int(n) for n in names if n.isdigit()], default=0)

    def read(self) -> list:
        number = self.number()
        if not number:
            return []
        at, fs = self._fs(f"{self.path}/{number:010d}")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, entries: list, after: int | None = None) -> int:
        """Make ``entries`` the current list, if ``after`` is still the current number."""
        last = self.number()
        if after is not None and after != last:
            raise RuntimeError(f"version {after} of {self.path} is no longer the current one")
        draft, fs = self._fs(f"{self.path}/draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(entries).encode()))
        stream.close()
        final, _ = self._fs(f"{self.path}/{last + 1:010d}")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {last + 1} of {self.path} was written by another")
        return last + 1


class VersionedTable:
    """A Parquet table that is replaced or upserted as a whole."""

    def __init__(self, spark: SparkSession, path: str, options: dict[str, object] | None = None):
        """``options`` are of the Parquet writer."""
        self.spark, self.path, self.options = spark, path, {"compression": "zstd", **(options or {})}
        self.manifest = Manifest(spark, f"{path}/manifest")

    def read(self) -> DataFrame | None:
        """The current version; none before the first."""
        folders = self.manifest.read()
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def stage(self, rows: DataFrame) -> str:
        """Write ``rows`` to a folder that no version names yet."""
        folder = f"rows-{uuid.uuid4().hex}"
        rows.write.options(**self.options).parquet(f"{self.path}/{folder}")
        return folder

    def replace(self, rows: DataFrame) -> DataFrame:
        """Make ``rows`` the table."""
        number = self.manifest.number()
        self.manifest.commit([self.stage(rows)], number)
        return self.read()

    def upsert(self, rows: DataFrame, key: str = "id", keys: DataFrame | None = None) -> DataFrame:
        """Delete the rows whose key is in ``rows`` and insert ``rows``; both become visible at once.

        Keys alone show what stays, so rows that are replaced are not read or
        shuffled in full; ``rows`` is evaluated for its keys and once more, or
        only once where ``keys`` has them.  What was shuffled before is given up first.
        """
        number, now = self.manifest.number(), self.read()
        with passing(self.spark):
            if now is not None:
                keys = rows if keys is None else keys
                stays = cut_lineage(now.select(key).join(keys.select(key).distinct(), key, "left_anti"), "kept-keys")
                if fits(stays, 0):
                    kept = now.limit(0)
                else:
                    stays = stays.select(F.col(key).alias("_kept"))
                    kept = now.join(stays, F.col(key).eqNullSafe(F.col("_kept")), "left_semi")
                rows = kept.unionByName(rows, allowMissingColumns=True)
            sweep(self.spark)
            self.manifest.commit([self.stage(rows)], number)
        return self.read()
