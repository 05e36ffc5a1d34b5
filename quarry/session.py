"""Session settings, shared scratch space and size checks."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# A query-side table is shipped to every task only below this many rows;
# beyond it the operators switch to a partitioned plan.
SMALL_SIDE_ROWS = 4096

LOCAL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: str = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quarry")
    for key, value in LOCAL_SETTINGS.items():
        builder = builder.config(key, value)
    partitions = "8" if cores == "*" else cores
    spark = (
        builder.config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application; they need not have the folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="quarry-ship-"), "quarry-package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(top.rglob("*.py")):
            archive.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared checkpoint folder of the cluster.

    Only a local master may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = os.path.join(tempfile.gettempdir(), "quarry-scratch")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_PASSING: ContextVar[dict[str, DataFrame] | None] = ContextVar("passing", default=None)


# A Parquet reader holds a row group's rows up to 4096 at once: for rows of megabytes each is a group of its own.
WIDE_ROWS = {"parquet.block.size": 1 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def cut_lineage(df: DataFrame, purpose: str = "cut", options: dict[str, int] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``options`` are of the Parquet writer."""
    path = shared_dir(df.sparkSession, purpose)
    # Ids are hexadecimal digests, half of whose bits are redundant: Snappy leaves them as they are, Zstandard halves them.
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _PASSING.get() is not None:
        _PASSING.get()[path] = out
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What this thread stages by :func:`cut_lineage` within is deleted at the end, but for the tables given to ``keep``."""
    outer, mine = _PASSING.get(), {}
    token = _PASSING.set(mine)

    def keep(df: DataFrame) -> DataFrame:
        for path in [p for p, staged in mine.items() if staged is df]:
            del mine[path]
            if outer is not None:
                outer[path] = df
        return df

    try:
        yield keep
    finally:
        _PASSING.reset(token)
        for path in mine:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it finds them when the driver collects garbage."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def file_states(df: DataFrame) -> tuple[tuple[str, int, int], ...]:
    """(name, size, time of change) of the files that ``df`` reads: a table that was rewritten differs."""
    spark, out = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def fits(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads no more than needed)."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame) -> DataFrame:
    """Spread an input of few files over all cores.

    A scan has at least one task per row group; a small table in one file
    would leave row-wise work such as tokenising to a single task.  Inputs that
    already have a task per core are left alone, so large tables never shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
