"""Nearest vectors by collision-counting hashing.

Every vector is projected on random directions.  The index holds, for blocks of
vectors, each direction's projections as a sorted array.  For a query, windows
around its own projections are widened step by step in all arrays of a block
(virtual rehashing); a vector that stands in the windows of enough directions
is verified with its exact cosine.  A vector at distance d from the query
stands in a window of half width w with probability P(|N(0, d)| <= w), so the
search of a block ends when the windows are so wide that a vector nearer than
the best found would have passed the threshold with the given confidence.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import ordered_parts, part_bases, stage

INDEX = "dim int, rows int, ids binary, vectors binary, sorted binary, places binary"
_APART = 64.0  # between the arrays of two directions in one flat array; unit vectors project to well within it


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of rows with an id and a vector of finite components that is not null, empty or zero."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("vector")).filter(
        F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0))


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = 64,
                block_rows: int = 4096, seed: int = 11) -> DataFrame:
    """Staged index of every usable row, in blocks of one dimension each."""

    def work(batches):
        held: dict[int, tuple[list, list]] = {}

        def block(dim):
            ids, rows = held.pop(dim)
            ids, x = np.concatenate(ids), np.concatenate(rows)
            unit = x / np.abs(x).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            across = (unit @ directions(dim, count, seed)).T
            places = np.argsort(across, axis=1, kind="stable").astype(np.int32)
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "rows": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()],
                "vectors": [x.tobytes()], "sorted": [np.take_along_axis(across, places, 1).tobytes()],
                "places": [places.tobytes()]})

        for batch in batches:
            ids = batch.column("id").to_numpy()
            lists = batch.column("vector")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            sizes = np.diff(offsets)
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                for low in range(0, len(mine), block_rows):
                    part = mine[low:low + block_rows]
                    own = held.setdefault(dim, ([], []))
                    own[0].append(ids[part])
                    own[1].append(flat[offsets[part][:, None] + np.arange(dim)])
                    if sum(map(len, own[0])) >= block_rows:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return stage(usable(vectors, key, vector).mapInArrow(work, INDEX), "index")


def _block_search(queries: list[tuple[int, np.ndarray]], best: dict[int, list], row: dict, k: int, count: int, seed: int,
                  threshold: float, confidence: float, first: float, growth: float) -> None:
    """Add what a block of the index has for each query to ``best`` (position: [(-score, id)] of at most k)."""
    dim, n = row["dim"], row["rows"]
    mine = [(i, q) for i, (_, q) in enumerate(queries) if len(q) == dim]
    if not mine:
        return
    ids = np.frombuffer(row["ids"], np.int64)
    x = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
    norms = np.linalg.norm(x, axis=1)
    places = np.frombuffer(row["places"], np.int32).reshape(count, n).astype(np.intp)
    lift = np.arange(count) * _APART
    flat = (np.frombuffer(row["sorted"], np.float64).reshape(count, n) + lift[:, None]).ravel()
    at = np.stack([q for _, q in mine])
    unit = at / np.abs(at).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    across = unit @ directions(dim, count, seed)
    need = int(np.ceil(threshold * count))
    # share of directions at which a vector passes the threshold with this confidence, and its window per distance
    share = min(0.999, threshold + NormalDist().inv_cdf(confidence) * np.sqrt(threshold * (1 - threshold) / count))
    per_distance = NormalDist().inv_cdf((1 + share) / 2)
    base = np.arange(count) * n
    for (i, q), center in zip(mine, across, strict=True):
        found = best.setdefault(i, [])
        hits = np.zeros(n, np.int64)
        done = np.zeros(n, bool)
        done[ids == queries[i][0]] = True
        low = high = None
        half, size = first, np.linalg.norm(q)
        while True:
            # as wide as the distance of the k-th best asks for, if that is known to be wider
            kth = -found[-1][0] if len(found) == k else -1.0
            target = per_distance * np.sqrt(max(0.0, 2 - 2 * kth))
            half = min(max(half, first), target) if len(found) == k else half
            new_low = np.searchsorted(flat, center - half + lift, "left") - base
            new_high = np.searchsorted(flat, center + half + lift, "right") - base
            if low is None:
                strips = [places[j, a:b] for j, (a, b) in enumerate(zip(new_low, new_high, strict=True))]
            else:
                strips = [places[j, a:b] for j, (a, b) in enumerate(zip(new_low, low, strict=True)) if a < b]
                strips += [places[j, a:b] for j, (a, b) in enumerate(zip(high, new_high, strict=True)) if a < b]
            if strips:
                hits += np.bincount(np.concatenate(strips), minlength=n)
            low = new_low if low is None else np.minimum(low, new_low)
            high = new_high if high is None else np.maximum(high, new_high)
            chosen = np.flatnonzero((hits >= need) & ~done)
            if len(chosen):
                done[chosen] = True
                score = (x[chosen] @ q) / (norms[chosen] * size)
                if len(found) == k:
                    keep = score >= kth
                    chosen, score = chosen[keep], score[keep]
                if len(chosen) > k:
                    edge = np.partition(score, -k)[-k]
                    keep = score >= edge
                    chosen, score = chosen[keep], score[keep]
                found = sorted(found + [(-s, int(ids[c])) for c, s in zip(chosen, score, strict=True)])[:k]
                best[i] = found
            kth = -found[-1][0] if len(found) == k else -1.0
            if half >= per_distance * np.sqrt(max(0.0, 2 - 2 * kth)) or (new_low == 0).all() and (new_high == n).all():
                break
            half *= growth


def search(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5,
           count: int = 64, seed: int = 11, threshold: float = 0.66, confidence: float = 0.97, first: float = 0.6,
           growth: float = 1.2, block_queries: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the k nearest found in ``index``.

    Queries go in blocks of ``block_queries`` rows, the only data sent to all
    tasks; each block makes one pass over the index, which stays in place, and
    each task returns at most k rows for each query.  Candidates with the
    query's own id are left out.  Ties go to the smaller id.  Unusable queries
    (null id, or a null, zero or not finite vector) take no part; a repeated
    query id counts once, with its smallest vector.  Vectors of another length
    are no candidates; with fewer than k candidates all are returned.
    """
    spark = index.sparkSession
    asked = usable(queries, key, vector).groupBy("id").agg(F.min("vector").alias("vector"))
    parts = ordered_parts(asked, "id", purpose="queries")
    numbered = parts.join(F.broadcast(part_bases(parts, F.lit(1))), "_part").select(
        "id", "vector", F.expr(f"(_base + _at) div {block_queries}").alias("block"))
    blocks = numbered.agg(F.max("block")).first()[0]
    shape = "query_id long, vec_id long, score double"
    out = None
    for block in range(-1 if blocks is None else blocks + 1):
        rows = numbered.filter(F.col("block") == block).collect()  # bounded by block_queries
        sent = spark.sparkContext.broadcast([(r["id"], np.array(r.vector, np.float64)) for r in rows])

        def work(batches, sent=sent):
            best: dict[int, list] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    _block_search(sent.value, best, row, k, count, seed, threshold, confidence, first, growth)
            flat = [(sent.value[i][0], v, -s) for i, found in best.items() for s, v in found]
            columns = list(zip(*flat, strict=True)) if flat else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                ["query_id", "vec_id", "score"])

        found = index.mapInArrow(work, shape)
        found = found if blocks == 0 else stage(found, "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
