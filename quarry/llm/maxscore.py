"""Ranked lexical search over integer impacts with bounds of term pairs.

The index is a table of shards.  A shard holds some thousands of documents and,
for each term in them, the documents with their term frequencies.  For a block
of items their terms get impacts, and the shard a largest impact of each term.
The terms of an item, ordered by document frequency, are paired neighbour with
neighbour; each pair has its own list in every shard: the documents that hold
both, and the largest sum of both impacts in one of them.

A document can win from a pair what the pair's list allows, or what one of the
two terms allows, and not the sum of both maxima.  The bounds of an item's pairs
add up to what a shard can still give: a shard whose sum stays below the
threshold is left out, documents that stand only in lists whose bounds add up to
less are never looked at, and a candidate goes as soon as its score and what is
left for it fall short.  The threshold is the k-th score in a sixteenth of the
shards; it is a bound only, and the same search runs over all shards with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.common import ordered_parts, stage
from quarry.llm.words import runs_of

SHARD_DOCS, SHARD_BYTES = 2048, 4_000_000  # a shard ends when it holds either
BLOCK_TERMS = 1_000_000  # item terms that travel to the tasks at once (some 40 MB)
SEED_SHARE = 16  # one shard in so many gives the first thresholds
# A term is a longest run of other bytes: 0-9, A-Z, a-z and all of other alphabets.
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _bytes(arrays: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


def _small(x: np.ndarray) -> np.ndarray:
    """In 16 bits where that holds all values, else in 32."""
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)


def _read(cell: pa.Scalar, n: int | None = None, kind=None) -> np.ndarray:
    """Back from bytes; the width follows from the number of values where it varies."""
    data = cell.as_buffer()
    if kind is None:
        kind = np.uint32 if n and data.size // n == 4 else np.uint16
    return np.frombuffer(data, kind)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of all rows, staged: ids, lengths, n_docs and n_terms, and terms (hashes) with their documents and frequencies.

    ``n_docs`` counts rows with a term, ``n_terms`` all terms with repeats.
    Rows without id are indexed and come last in a shard; repeated ids are rows of their own.
    """
    kind = docs.schema[key].dataType
    arrow = to_arrow_type(kind)

    def shard(keys, counts, hashes, owners) -> pa.RecordBatch:
        ids = pa.concat_arrays(keys)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))  # documents of a shard are numbered in the order of their ids
        terms, of = np.unique(np.concatenate(hashes), return_inverse=True)
        posts, tf = np.unique(of * len(order) + rank[np.concatenate(owners)], return_counts=True)
        starts = np.searchsorted(posts, np.arange(len(terms) + 1) * len(order))
        length = np.concatenate(counts)[order]
        return pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids.take(pa.array(order))),
            pa.array([int((length > 0).sum())]), pa.array([int(length.sum())]),
            *_bytes([length.astype(np.int64), terms, starts.astype(np.int64), _small(posts % max(1, len(order))), _small(tf)])],
            names=["ids", "n_docs", "n_terms", "lengths", "terms", "starts", "docs", "tfs"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, size = ([], [], [], []), 0, 0
        for batch in batches:
            ids = batch.column(0).cast(arrow)
            for low, words in runs_of(batch.column(1), space=SEPARATOR):
                for part, x in zip(parts, (ids.slice(low, words.rows), words.count, words.hash, words.text + n), strict=True):
                    part.append(x)
                n, size = n + words.rows, size + len(words.data)
                if n >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield shard(*parts)
                    parts, n, size = ([], [], [], []), 0, 0
        if n:
            yield shard(*parts)

    return stage(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        shards, f"ids array<{kind.simpleString()}>, n_docs long, n_terms long, lengths binary, terms binary, starts binary, "
                "docs binary, tfs binary"), "shards")


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, terms, times), staged: the distinct terms of each item and how often it holds each."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, words in runs_of(batch.column(2), space=SEPARATOR):
                found = [np.unique(words.hash[words.text == i], return_counts=True) for i in range(words.rows)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, words.rows) for c in (0, 1)), pa.array([t.view(np.int64) for t, _ in found],
                     pa.list_(pa.int64())), pa.array([n for _, n in found], pa.list_(pa.int64()))],
                    names=["row", "key", "terms", "times"])

    rows = ordered_parts(items.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", purpose="items")
    kind = items.schema[key].dataType.simpleString()
    row = (F.shiftleft("_part", 33) + F.col("_at")).alias("row")
    return stage(rows.select(row, "key", "text").mapInArrow(split, f"row long, key {kind}, terms array<long>, times array<long>"), "terms")


class _Block:
    """A block of items, ready to travel: their terms, weights and pairs."""

    def __init__(self, items: pa.Table) -> None:
        self.rows = items.column("row").to_numpy()
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in items.column("terms")], dtype=np.int64)])
        flat = items.column("terms").combine_chunks()
        hashes = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        self.times = items.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.terms, self.term = np.unique(hashes, return_inverse=True)
        self.weights = np.zeros(len(self.terms), np.int64)
        self.pairs, self.pair = np.zeros((0, 2), np.int64), []

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        """Weights by document frequency; each item's terms are put in that order and paired."""
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((self.terms, df))] = np.arange(len(df))
        item = np.repeat(np.arange(len(self.rows)), np.diff(self.starts))
        order = np.lexsort((rank[self.term], item))
        self.term, self.times = self.term[order], self.times[order]
        place = np.arange(len(order)) - self.starts[item]
        first = np.flatnonzero((place % 2 == 0) & (np.append(item[1:], -1) == item))
        found, which = np.unique(np.stack([self.term[first], self.term[first + 1]], 1), axis=0, return_inverse=True)
        self.pairs = found.reshape(-1, 2)
        pair = np.full(len(order), -1, np.int64)
        pair[first] = which.reshape(-1)
        self.pair = pair


def _frequencies(index: DataFrame, block: _Block) -> np.ndarray:
    """Documents that hold each term of the block, over all shards."""
    given = index.sparkSession.sparkContext.broadcast(block.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, df = given.value, np.zeros(len(given.value), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                terms, starts = _read(batch.column(0)[i], kind=np.uint64), _read(batch.column(1)[i], kind=np.int64)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
                    df += np.where(terms[at] == asked, starts[at + 1] - starts[at], 0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(df[at])], names=["term", "df"])

    found = index.select("terms", "starts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(len(block.terms), np.int64)
    for r in found.collect():  # at most one for each term of the block
        df[r["term"]] = r["df"]
    return df


LISTS = ("term", "starts", "docs", "gains", "most", "pair", "pair_starts", "pair_docs", "joint")


def impact_lists(index: DataFrame, block: _Block, n_docs: int, n_terms: int) -> DataFrame:
    """Per shard, staged: impacts of the block's terms with their maxima, and the intersection list of each pair with its joint maximum."""
    given = index.sparkSession.sparkContext.broadcast((block.terms, block.weights, block.pairs))
    ids = index.schema["ids"].dataType.simpleString()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights, pairs = given.value
        for batch in batches:
            for i in range(len(batch)):
                length, terms, starts = (_read(batch.column(c)[i], kind=k) for c, k in
                                         ((1, np.int64), (2, np.uint64), (3, np.int64)))
                n = int(starts[-1])
                docs, tf = _read(batch.column(4)[i], n), _read(batch.column(5)[i], n).astype(np.int64)
                at = np.minimum(np.searchsorted(terms, asked), max(0, len(terms) - 1))
                here = np.flatnonzero(terms[at] == asked) if len(terms) else np.zeros(0, np.int64)
                size = (starts[at + 1] - starts[at])[here] if len(terms) else np.zeros(0, np.int64)
                edge = np.concatenate([[0], np.cumsum(size)])
                from_ = np.repeat(starts[at[here]] - edge[:-1], size) + np.arange(edge[-1])
                docs, tf = docs[from_], tf[from_]
                m = 75 + (25 * length * n_docs) // max(1, n_terms)
                gains = (1_000_000_000 * tf) // (1000 * tf + 12 * m[docs])
                most = np.maximum.reduceat(gains, edge[:-1]) * weights[here] if len(here) else np.zeros(0, np.int64)
                place = np.full(len(asked), -1, np.int64)
                place[here] = np.arange(len(here))
                of, parts, joint = [], [], []
                for p in np.flatnonzero((place[pairs] >= 0).all(1)).tolist() if len(pairs) else []:
                    x, y = place[pairs[p]].tolist()
                    if edge[x + 1] - edge[x] > edge[y + 1] - edge[y]:
                        x, y = y, x
                    dx, dy = docs[edge[x]:edge[x + 1]], docs[edge[y]:edge[y + 1]]
                    spot = np.minimum(np.searchsorted(dy, dx), len(dy) - 1)
                    same = dy[spot] == dx
                    if same.any():
                        both = gains[edge[x]:edge[x + 1]][same] * weights[here[x]] + gains[edge[y]:edge[y + 1]][spot[same]] * weights[here[y]]
                        of.append(p)
                        parts.append(dx[same])
                        joint.append(int(both.max()))
                cells = [here.astype(np.int64), edge, docs, gains.astype(np.uint32), most, np.array(of, np.int64),
                         np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)]),
                         np.concatenate(parts) if parts else docs[:0], np.array(joint, np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *_bytes(cells)], names=["ids", *LISTS])

    return stage(index.select("ids", "lengths", "terms", "starts", "docs", "tfs").mapInArrow(
        lists, f"ids {ids}, " + ", ".join(f"{c} binary" for c in LISTS)), "impacts")


class _Shard:
    """The lists of one shard."""

    def __init__(self, batch: pa.RecordBatch, i: int, n_terms: int, n_pairs: int) -> None:
        cell = lambda c: batch.column(1 + LISTS.index(c))[i]
        self.n_docs = len(batch.column(0)[i])
        term, self.starts, self.most, pair, self.pair_starts, self.joint = (
            _read(cell(c), kind=np.int64) for c in ("term", "starts", "most", "pair", "pair_starts", "joint"))
        self.gains = _read(cell("gains"), kind=np.uint32)
        self.docs = _read(cell("docs"), len(self.gains))
        self.pair_docs = _read(cell("pair_docs"), int(self.pair_starts[-1]))
        self.place, self.pair_place = np.full(n_terms, -1, np.int64), np.full(n_pairs, -1, np.int64)
        self.place[term] = np.arange(len(term))
        self.pair_place[pair] = np.arange(len(pair))

    def postings(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[p], self.starts[p + 1]
        return self.docs[a:b], self.gains[a:b]

    def both(self, p: int) -> np.ndarray:
        """Documents of a pair's list."""
        return self.pair_docs[self.pair_starts[p]:self.pair_starts[p + 1]]


def unit_bounds(most: np.ndarray, times: np.ndarray, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a document can win from each pair of terms (2i, 2i + 1), and what one that is not in the pair's list can.

    ``most`` are the largest impacts of the terms, ``times`` how often the item
    holds each, ``joint`` the largest sum of the impacts of a pair in one
    document (0: in none).  A term that is left over is a pair with nothing.
    """
    won = np.append(most * times, 0) if len(most) % 2 else most * times
    each = np.append(times, 0) if len(most) % 2 else times
    alone = np.maximum(won[0::2], won[1::2])
    return np.maximum(alone, np.minimum(won[0::2] + won[1::2], joint * np.maximum(each[0::2], each[1::2]))), alone


def best_in_shard(shard: _Shard, terms: np.ndarray, times: np.ndarray, pairs: np.ndarray, weights: np.ndarray, k: int,
                  least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of at most ``k`` documents of a shard with a score of ``least`` or more, best first."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = shard.place[terms]
    found = place >= 0
    if not found.any():
        return none
    most = np.where(found, shard.most[np.where(found, place, 0)], 0)
    listed = np.where(pairs >= 0, shard.pair_place[np.maximum(pairs, 0)], -1) if len(shard.pair_place) else np.full(len(pairs), -1)
    joint = np.where(listed >= 0, shard.joint[np.where(listed >= 0, listed, 0)], 0) if len(shard.joint) else np.zeros(len(pairs), np.int64)
    bound, alone = unit_bounds(most, times, joint)
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the units from here on can give
    if not len(order) or rest[0] < least:
        return none
    scores = np.zeros(shard.n_docs, np.int64)
    members = lambda u: [t for t in (2 * u, 2 * u + 1) if t < len(terms) and found[t] and most[t] > 0]
    j = 0
    while j < len(order) and rest[j] >= least:  # lists that can make a winner on their own
        for t in members(order[j]):
            docs, gains = shard.postings(place[t])
            scores[docs] += gains * (weights[terms[t]] * times[t])
        j += 1
        if j & (j - 1) == 0 and shard.n_docs > k:  # now and then: the k-th score so far
            least = max(least, int(np.partition(scores, -k)[-k]))
    candidates = np.flatnonzero((scores > 0) & (scores + rest[j] >= least))
    while j < len(order) and len(candidates):  # the other lists only where a candidate stands
        u = order[j]
        if listed[u] >= 0 and alone[u] < bound[u]:
            outside = ~np.isin(candidates, shard.both(listed[u]), assume_unique=True)
            candidates = candidates[~outside | (scores[candidates] + alone[u] + rest[j + 1] >= least)]
        for t in members(u):
            docs, gains = shard.postings(place[t])
            spot = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
            hit = docs[spot] == candidates
            scores[candidates[hit]] += gains[spot[hit]] * (weights[terms[t]] * times[t])
        j += 1
        candidates = candidates[scores[candidates] + rest[j] >= least]
    top = candidates[np.lexsort((candidates, -scores[candidates]))[:k]]
    return top, scores[top]


def _scan(lists: DataFrame, block: _Block, least: np.ndarray, k: int) -> DataFrame:
    """(row, id, score): the best of each shard that reach the item's threshold."""
    given = lists.sparkSession.sparkContext.broadcast(
        (block.rows, block.starts, block.term, block.times, block.pair, block.weights, len(block.pairs), least))
    kind = lists.schema["ids"].dataType.elementType
    arrow = to_arrow_type(kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, starts, term, times, pair, weights, n_pairs, least = given.value
        for batch in batches:
            for i in range(len(batch)):
                shard, out = _Shard(batch, i, len(weights), n_pairs), []
                for q in range(len(rows)):
                    a, b = starts[q], starts[q + 1]
                    docs, scores = best_in_shard(shard, term[a:b], times[a:b], pair[a:b:2], weights, k, int(least[q]))
                    if len(docs):
                        out.append((np.full(len(docs), rows[q]), docs, scores))
                if out:
                    row, docs, scores = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row), batch.column(0)[i].values.take(pa.array(docs)).cast(arrow), pa.array(scores)],
                        names=["row", "id", "score"])

    return lists.mapInArrow(scan, f"row long, id {kind.simpleString()}, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    from quarry.operators.ranking import top_k

    return top_k(found, ["row"], [F.col("score").desc(), F.col("id").asc_nulls_last()], k)


def search(index: DataFrame, items: DataFrame, k: int = 20, key: str = "item_id", text: str = "text", doc_key: str = "doc_id",
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` best documents of every item: key, rank, doc_key, score; equal scores by ascending id, rows without id last.

    Scores are above 0.  A null or empty item or document has no terms and no
    hits.  Null and repeated item keys are items of their own, repeated document
    ids rows of their own.  Items are asked in blocks of ``block_terms`` terms,
    each in one pass over the whole index, and columns other than key and text
    are not read.
    """
    asked = item_terms(items, key, text)
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 0
    n_blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms))
    found = None
    for b in range(n_blocks):
        block = _Block(asked.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b).select("row", "terms", "times").toArrow())
        block.weigh(_frequencies(index, block), n_docs)
        lists = impact_lists(index, block, n_docs, n_terms)
        seeds = _top(_scan(lists.filter(F.pmod(F.xxhash64("ids"), F.lit(SEED_SHARE)) == 0), block,
                           np.ones(len(block.rows), np.int64), k), k)
        reached = {r["row"]: r["score"] for r in seeds.filter(F.col("rank") == k).collect()}
        least = np.array([reached.get(r, 1) for r in block.rows.tolist()], np.int64)
        part = _top(_scan(lists, block, least, k), k)
        found = part if found is None else found.unionByName(part)
    return found.join(asked.select("row", F.col("key")), "row").select(
        F.col("key").alias(key), "rank", F.col("id").alias(doc_key), "score")


def search_sql(k: int = 20) -> str:
    """The same for DuckDB, over ``benchmark`` and ``documents``."""
    words = (r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term")
    return rf"""
WITH doc AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
item AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, {words} FROM doc) GROUP BY ALL),
n AS (SELECT d, sum(tf)::BIGINT AS n FROM tf GROUP BY d),
tot AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
w AS (SELECT term, floor(1000 * ln((2.0 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, tot GROUP BY term),
qt AS (SELECT i, term, count(*) AS times FROM (SELECT i, {words} FROM item) GROUP BY ALL),
scored AS (SELECT i, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
           FROM qt JOIN tf USING (term) JOIN w USING (term) JOIN n USING (d), tot GROUP BY ALL),
ranked AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
           FROM scored JOIN doc USING (d) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN item USING (i) WHERE rank <= {k}"""
