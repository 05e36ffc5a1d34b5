"""Exact and cell-partitioned dense top-k (V1, V2, V4).

Scoring is a matrix product per Arrow batch inside the tasks that scan the
vectors.  A small query table (checked) travels to the tasks and the corpus is
never shuffled; otherwise both sides are cut into bounded blocks and each
block pair returns only its own top-k.  Neither path emits all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType

from quarry.functions.vectors import embedded, hash_vectors
from quarry.operators.ranking import top_k
from quarry.session import SMALL_SIDE_ROWS, fits, shared_dir

BLOCK_ROWS = 20_000
SCORE_CELLS = 1_000_000  # scores (queries by rows) and components that a scan holds at once
DIGITS = 9  # scores are compared at this precision, so equal vectors tie


def _matrix(vectors) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])


def _scores(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """Score matrix (queries x corpus); larger is better for every metric."""
    if metric == "cosine":
        qn = np.linalg.norm(queries, axis=1, keepdims=True)
        cn = np.linalg.norm(corpus, axis=1, keepdims=True)
        q = np.divide(queries, qn, out=np.zeros_like(queries), where=qn > 0)
        c = np.divide(corpus, cn, out=np.zeros_like(corpus), where=cn > 0)
        return np.round(q @ c.T, DIGITS) + 0.0
    sq = (queries * queries).sum(axis=1)[:, None] + (corpus * corpus).sum(axis=1)[None, :]
    return -np.round(np.maximum(sq - 2.0 * (queries @ corpus.T), 0.0), DIGITS) + 0.0


def best_positions(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores; earlier positions win ties."""
    if len(scores) <= k:
        return np.argsort(-scores, kind="stable")
    bound = -np.partition(-scores, k - 1)[k - 1]
    above = np.flatnonzero(scores > bound)
    ties = np.flatnonzero(scores == bound)[: k - len(above)]
    picked = np.concatenate([above, ties])
    return picked[np.lexsort((picked, -scores[picked]))]


def _block_topk(query_ids, queries: np.ndarray, pdf: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """Top-k of every query inside one block of corpus rows."""
    pdf = pdf.sort_values("id", kind="stable")
    ids = pdf["id"].to_numpy()
    scores = _scores(queries, _matrix(pdf["vec"].to_list()), metric)
    rows = [best_positions(row, k) for row in scores]
    return pd.DataFrame({
        "query_id": np.repeat(np.asarray(query_ids), [len(r) for r in rows]),
        "id": ids[np.concatenate(rows)],
        "score": np.concatenate([scores[i][r] for i, r in enumerate(rows)]),
    })


def _result_schema(corpus: DataFrame, queries: DataFrame) -> str:
    kind = lambda df, col: df.schema[col].dataType.simpleString()
    return f"query_id {kind(queries, 'query_id')}, id {kind(corpus, 'id')}, score double"


def _named(df: DataFrame, id_col: str, vec_col: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).alias(name), F.col(vec_col).alias("vec"))


def _shape(df: DataFrame, id_col: str, vec_col: str, name: str) -> DataFrame:
    return _held(_named(df, id_col, vec_col, name))


def _held(rows: DataFrame) -> DataFrame:
    """The rows with a vector, texts embedded.  A vector that is computed is computed for the filter too."""
    if isinstance(rows.schema["vec"].dataType, StringType):
        return rows.withColumn("vec", embedded(F.col("vec")))
    return rows.filter(F.size("vec") > 0)


def _slices(batches: Iterator[pa.RecordBatch], n_small: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors in runs whose scores against ``n_small`` rows are bounded; rows without a vector are left out.

    A column of texts (normalised) is embedded here, and not by a function of
    its own, whose vectors would travel from one Python worker to another.
    """
    for batch in batches:
        ids, values = batch.column(0), batch.column(1)
        if not pa.types.is_string(values.type):
            held = pc.fill_null(pc.greater(pc.list_value_length(values), 0), False)
            ids, values = ids.filter(held), values.filter(held)
        if not len(ids):
            continue
        width = None if pa.types.is_string(values.type) else len(values[0])
        rows = max(1, SCORE_CELLS // max(n_small, width or 256))
        for low in range(0, len(ids), rows):
            part = values.slice(low, rows)
            if width is None:
                yield ids.slice(low, rows), hash_vectors(part)
            elif pc.all(pc.equal(pc.list_value_length(part), width)).as_py():
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield ids.slice(low, rows), flat.reshape(-1, width)
            else:
                raise ValueError("vectors differ in length")
        batch = ids = values = part = None  # before the next one is read


class _Nearest:
    """The k best rows of each query that a task has met; equal scores go to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least = k, np.full(n, -np.inf)
        self.hits: tuple[np.ndarray, pa.Array, np.ndarray] | None = None

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        """``scores`` is queries by rows; what is below a query's k-th score so far, or in these rows, is left out first."""
        bound = self.least
        if scores.shape[1] > self.k:
            bound = np.maximum(bound, np.partition(scores, -self.k, axis=1)[:, -self.k])
        query, row = np.nonzero(scores >= bound[:, None])
        if not len(query):
            return
        found = query, ids.take(pa.array(row)), scores[query, row]
        if self.hits:
            a, b = self.hits, found
            found = np.concatenate([a[0], b[0]]), pa.concat_arrays([a[1], b[1]]), np.concatenate([a[2], b[2]])
        query, names, values = found
        by_id = pc.sort_indices(names, null_placement="at_start").to_numpy().astype(np.int64)
        order = by_id[np.lexsort((-values[by_id], query[by_id]))]
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        last = order[place == self.k - 1]
        self.least[query[last]] = values[last]
        order = order[place < self.k]
        self.hits = query[order], names.take(pa.array(order)), values[order]


def _search_small(corpus: DataFrame, queries: DataFrame, k: int, metric: str, schema: str) -> DataFrame:
    rows = queries.collect()  # bounded by the size check of the caller
    if not rows:
        return corpus.sparkSession.createDataFrame([], schema)
    kinds = [to_arrow_type(df.schema[c].dataType) for df, c in ((queries, "query_id"), (corpus, "id"))]
    shipped = corpus.sparkSession.sparkContext.broadcast(
        ([r["query_id"] for r in rows], _matrix([r["vec"] for r in rows])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shipped.value
        best = _Nearest(len(names), k)
        for ids, vectors in _slices(batches, len(names)):
            best.add(ids, _scores(matrix, vectors, metric))
        if best.hits:
            query, ids, scores = best.hits
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, kinds[0]).take(pa.array(query)), ids.cast(kinds[1]), pa.array(scores)], names=["query_id", "id", "score"])

    return corpus.mapInArrow(scan, schema)


def _search_blocks(corpus: DataFrame, queries: DataFrame, keys: list[str], k: int, metric: str,
                   schema: str) -> DataFrame:
    """Top-k within every pair of blocks that share ``keys``."""

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return _block_topk(left["query_id"].to_numpy(), _matrix(left["vec"].to_list()), right, k, metric)

    return queries.groupBy(*keys).cogroup(corpus.groupBy(*keys)).applyInPandas(pair, schema)


def _blocks(n_rows: int, size: int) -> int:
    return max(1, -(-n_rows // size))


def _spread(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _hashed(df: DataFrame, column: str, key: str, n) -> DataFrame:
    n = n if not isinstance(n, int) else F.lit(n)
    return df.withColumn(column, F.pmod(F.xxhash64(key), n.cast("long")).cast("int"))


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", doc_id: str = "vec_id",
               doc_vec: str = "embedding", query_id: str = "query_id", query_vec: str = "vec",
               small_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Exact top-k per query: (query_id, id, score, rank).

    ``metric`` is ``cosine`` or ``l2``; for ``l2`` the score is the squared
    distance and the smallest comes first.  ``doc_vec`` may hold normalised
    texts instead of vectors: they are embedded (F6) where they are scanned.
    """
    c, q = _named(corpus, doc_id, doc_vec, "id"), _shape(queries, query_id, query_vec, "query_id")
    schema = _result_schema(c, q)
    if fits(q, small_rows):
        found = _search_small(c, q, k, metric, schema)
    else:
        c = _held(c)
        n_q, n_c = _blocks(q.count(), small_rows), _blocks(c.count(), BLOCK_ROWS)
        q = _spread(_hashed(q, "qb", "query_id", n_q), "cb", n_c)
        c = _spread(_hashed(c, "cb", "id", n_c), "qb", n_q)
        found = _search_blocks(c, q, ["qb", "cb"], k, metric, schema)
    return _finish(found, k, metric)


def _finish(found: DataFrame, k: int, metric: str) -> DataFrame:
    best = top_k(found, ["query_id"], [F.col("score").desc(), F.col("id")], k)
    return best.withColumn("score", -F.col("score") + 0.0) if metric == "l2" else best


def keyed_topk(corpus: DataFrame, queries: DataFrame, key: str, k: int = 5, metric: str = "l2",
               doc_id: str = "vec_id", doc_vec: str = "embedding", query_id: str = "query_id",
               query_vec: str = "vec", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact top-k among the corpus rows that share the query's ``key`` (V2 recall).

    Keys are cut into blocks by their own row count, so a key that holds a
    third of the corpus becomes many tasks.
    """
    c = corpus.select(F.col(key).alias("key"), F.col(doc_id).alias("id"), F.col(doc_vec).alias("vec"))
    q = queries.select(F.col(key).alias("key"), F.col(query_id).alias("query_id"), F.col(query_vec).alias("vec"))
    schema = _result_schema(c, q)
    size = lambda df, n, name: df.groupBy("key").agg(F.ceil(F.count("*") / F.lit(n)).cast("int").alias(name))
    sizes = size(c, block_rows, "nc").join(size(q, SMALL_SIDE_ROWS, "nq"), "key")
    spread = lambda name, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    c = _hashed(c.join(sizes, "key"), "cb", "id", F.col("nc")).select("key", "id", "vec", "cb", spread("qb", "nq"))
    q = _hashed(q.join(sizes, "key"), "qb", "query_id", F.col("nq")).select(
        "key", "query_id", "vec", "qb", spread("cb", "nc"))
    return _finish(_search_blocks(c, q, ["key", "qb", "cb"], k, metric, schema), k, metric)


class CellIndex:
    """Vectors in k-means cells (V4): a folder of Parquet partitions by cell, and the cells' centroids.

    A search reads the partitions of the cells that its queries probe and no
    others.  Rows are added without a new fit; they go to the cells that stand.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def cells(self) -> DataFrame:
        """(id, vec, cell), cell being the partition."""
        return self.spark.read.parquet(f"{self.path}/cells")

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids")

    @classmethod
    def build(cls, corpus: DataFrame, doc_id: str = "vec_id", doc_vec: str = "embedding", n_cells: int = 128,
              seed: int = 7, max_iter: int = 10, path: str | None = None) -> CellIndex:
        """Train centroids on all vectors, assign each to its cell, and store both."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = corpus.sparkSession
        index = cls(spark, path or shared_dir(spark, "cells"))
        c = _unit_rows(corpus, doc_id, doc_vec).withColumn("_f", array_to_vector("_unit"))
        n = c.count()
        if not n:
            spark.createDataFrame([], "cell int, vec array<double>").write.parquet(f"{index.path}/centroids")
            _shape(corpus, doc_id, doc_vec, "id").withColumn("cell", F.lit(0)).limit(0).write.parquet(f"{index.path}/cells")
            return index
        model = KMeans(k=min(n_cells, n), seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="cell").fit(c.select("_f"))
        centers = [(i, [float(x) for x in v]) for i, v in enumerate(model.clusterCenters())]  # n_cells rows, a parameter
        spark.createDataFrame(centers, "cell int, vec array<double>").write.parquet(f"{index.path}/centroids")
        index.add(corpus, doc_id, doc_vec)
        return index

    def add(self, corpus: DataFrame, doc_id: str = "vec_id", doc_vec: str = "embedding") -> CellIndex:
        """Append vectors to the cells of their nearest centroids; zero vectors stay out."""
        rows = _unit_rows(corpus, doc_id, doc_vec).select("id", "vec")
        placed = _nearest_cells(rows, self.centroids, 1).select("id", "vec", "cell")
        placed.write.mode("append").partitionBy("cell").parquet(f"{self.path}/cells")
        return self

    def probed(self, probes: DataFrame) -> DataFrame:
        """The partitions that ``probes.cell`` names; at most n_cells numbers reach the plan."""
        wanted = [r["cell"] for r in probes.select("cell").distinct().collect()]
        return self.cells.filter(F.col("cell").isin(wanted))

    def search(self, queries: DataFrame, k: int = 5, n_probe: int = 16, query_id: str = "query_id",
               query_vec: str = "vec") -> DataFrame:
        q = _shape(queries, query_id, query_vec, "query_id")
        # Centroids are the small side here: the queries are scanned once.
        probes = _nearest_cells(q, self.centroids, n_probe)
        return keyed_topk(self.probed(probes), probes, "cell", k, "cosine", "id", "vec", "query_id", "vec")


def _unit_rows(corpus: DataFrame, doc_id: str, doc_vec: str) -> DataFrame:
    """(id, vec, _unit) of the vectors that have a direction."""
    length = F.expr("sqrt(aggregate(vec, 0D, (s, x) -> s + cast(x as double) * x))")
    rows = _shape(corpus, doc_id, doc_vec, "id").withColumn("_n", length).filter("_n > 0")
    return rows.withColumn("_unit", F.expr("transform(vec, x -> cast(x as double) / _n)")).drop("_n")


def _nearest_cells(queries: DataFrame, centroids: DataFrame, n_probe: int) -> DataFrame:
    rows = centroids.collect()  # n_cells rows, a parameter
    shipped = queries.sparkSession.sparkContext.broadcast(
        (np.array([r["cell"] for r in rows]), _matrix([r["vec"] for r in rows])))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, centers = shipped.value
        for pdf in batches:
            if not len(pdf):
                continue
            scores = _scores(_matrix(pdf["vec"].to_list()), centers, "cosine")
            picked = [best_positions(row, n_probe) for row in scores]
            out = pdf.loc[pdf.index.repeat([len(p) for p in picked])].copy()
            out["cell"] = cells[np.concatenate(picked)]
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields) + ", cell int"
    return queries.mapInPandas(probe, schema)


def best_match(queries: DataFrame, entries: DataFrame, query_id: str, query_vec: str, entry_id: str,
               entry_vec: str, small_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Best entry per query; scans the queries when the entries are the small side."""
    e, q = _shape(entries, entry_id, entry_vec, "id"), _named(queries, query_id, query_vec, "query_id")
    if not fits(e, small_rows):
        return dense_topk(entries, _held(q), 1, "cosine", entry_id, entry_vec, "query_id", "vec", small_rows)
    rows = e.orderBy("id").collect()  # bounded by the size check
    schema = _result_schema(e, q)
    if not rows:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    kinds = [to_arrow_type(df.schema[c].dataType) for df, c in ((q, "query_id"), (e, "id"))]
    shipped = queries.sparkSession.sparkContext.broadcast(
        ([r["id"] for r in rows], _matrix([r["vec"] for r in rows])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shipped.value
        for ids, vectors in _slices(batches, len(names)):
            scores = _scores(vectors, matrix, "cosine")
            best = scores.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(kinds[0]), pa.array(names, kinds[1]).take(pa.array(best)), pa.array(scores[np.arange(len(best)), best])],
                names=["query_id", "id", "score"])

    return q.mapInArrow(scan, schema).withColumn("rank", F.lit(1))
