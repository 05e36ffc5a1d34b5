"""Jaccard join of shingle sets with PartEnum signatures.

Sets are cut into bands of size, so that a set is only similar to sets of its
own and the two adjacent bands.  Family t of signatures is for pairs whose
smaller set is in band t; such a pair differs in at most k features, k being a
bound for the band.  The feature domain is hashed into parts, each part into
``split`` pieces; a pair that differs in at most k features has a part in which
it differs in at most ``spare``, and so agrees on the features of some
``split - spare`` pieces of it.  Each choice of pieces gives a signature.  A
set with too many parts that have a choice without features also emits
signatures of empty choices, which keeps the join exact; others leave them out.

Sets with a signature in common are brought together under the smallest of
them.  Odd sketches, a lower bound of the features in which two sets differ,
leave out sets that are similar to none they meet; all pairs of the others are
verified exactly, block by block.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import rows_by_id, stage, width
from quarry.llm.components import components
from quarry.llm.words import mix, runs_of

BLOCK = 256  # sets of at most this weight are verified together on each side
WEIGHT = 2_000  # features that count as one more set in a block


@lru_cache(maxsize=8)
def bands(num: int, den: int, most: int = 1 << 40) -> list[int]:
    """Largest size of each band for a similarity of num / den."""
    tops, low = [], 1
    while low < most:
        tops.append(low * den // num)
        low = tops[-1] + 1
    return tops


@lru_cache(maxsize=4096)
def scheme(top: int, low: int, num: int, den: int) -> tuple[int, int, int, int]:
    """(parts, split, spare, parts that must have no empty choice) of the family of a band.

    A pair of similarity num / den or more with a smaller set of ``top``
    features differs in at most k = top * (den - num) / num.
    """
    k = top * (den - num) // num
    if k <= 2:  # few differences: one part, and choices that hold most of its pieces
        split, spare = (2 * k + 2, k) if k else (1, 0)
        return 1, split, spare, 1
    split, spare = (4, 1) if k <= 8 else (2, 1)
    needed = k // (spare + 1) + 1
    inside = low / (needed * split) * (split - spare)
    lost = needed * split * exp(-inside)
    return needed + ceil(lost + 3 * sqrt(lost)), split, spare, needed


def signatures(features: np.ndarray, offsets: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of many sets, one after another, and the offsets of the sets; an empty set has none."""
    tops = bands(num, den)
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes)
    band = np.searchsorted(tops, sizes[rows])
    found, owner = [], []
    for behind in (0, 1):  # as the smaller set of a pair, and as the larger one from the band above
        for t in np.unique(band - behind):
            mine = rows[band - behind == t]
            if t < 0 or not len(mine):
                continue
            parts, split, spare, needed = scheme(tops[t], tops[t - 1] + 1 if t else 1, num, den)
            text = np.repeat(np.arange(len(mine)), sizes[mine])
            begin = np.cumsum(sizes[mine]) - sizes[mine]
            value = features[np.repeat(offsets[mine] - begin, sizes[mine]) + np.arange(len(text))]
            value = mix(value ^ np.uint64((int(t) * 0x9FB21C651E98DF25 + 1) % (1 << 64)))
            piece = ((value >> np.uint64(32)) * np.uint64(parts * split)) >> np.uint64(32)
            cell = text * (parts * split) + piece.astype(np.int64)
            n_cells = len(mine) * parts * split
            held = np.bincount(cell, minlength=n_cells).reshape(-1, split)
            total = np.zeros(n_cells, np.uint64)
            np.add.at(total, cell, mix(value + np.uint64(0x632BE59BD9B4E019)))
            total = total.reshape(-1, split)
            choices = list(combinations(range(split), split - spare))
            filled = np.stack([held[:, c].sum(axis=1) > 0 for c in choices], axis=1)
            solid = filled.all(axis=1).reshape(len(mine), parts).sum(axis=1) >= needed
            wanted = filled | ~np.repeat(solid, parts)[:, None]
            place = np.tile(np.arange(parts, dtype=np.uint64), len(mine))[:, None] * np.uint64(len(choices)) \
                + np.arange(len(choices), dtype=np.uint64)
            sums = np.stack([total[:, c].sum(axis=1, dtype=np.uint64) for c in choices], axis=1)
            seed = np.uint64((int(t) + 1) * 0xD1342543DE82EF95 % (1 << 64))
            signed = mix(mix(sums) ^ mix(place * np.uint64(0xAF251AF3B0F025B5) + seed))
            part, _ = np.nonzero(wanted)
            found.append(signed[wanted])
            owner.append(mine[part // parts])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(sizes) + 1, np.int64)
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])


def linked(sets: list[np.ndarray], left: int, num: int, den: int, of: list | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with similarity num / den or more.

    With ``left`` below the number of sets only pairs between the first
    ``left`` sets and the rest count, else all pairs.  Sets of equal ``of``
    are no pair.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    if n == 2:
        if of is not None and of[0] == of[1]:
            return []
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if common and den * common >= num * (sizes.sum() - common) else []
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    lengths = np.diff(np.append(starts, len(values)))
    several = lengths > 1
    of_value = np.repeat(np.arange(len(starts)), lengths)
    keep = several[of_value]
    by_set = np.argsort(owner[keep], kind="stable")
    of_set = of_value[keep][by_set]
    edge = np.searchsorted(owner[keep][by_set], np.arange(n + 1))
    for i in range(left if left < n else n - 1):
        mine = of_set[edge[i]:edge[i + 1]]
        if not len(mine):
            continue
        count = lengths[mine]
        begin = np.cumsum(count) - count
        near = owner[np.repeat(starts[mine] - begin, count) + np.arange(count.sum())]
        common = np.bincount(near, minlength=n)
        common[:left if left < n else i + 1] = 0
        for j in np.flatnonzero((common > 0) & (den * common >= num * (sizes[i] + sizes - common))).tolist():
            if of is not None and of[i] == of[j]:
                continue
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def together(signed: DataFrame) -> DataFrame:
    """Distinct (center, member) of rows (signature, node): the nodes of a signature under the smallest one.

    Rows are sorted into ranges of (signature, node) and read once in order, so
    a signature of any number of nodes spreads over tasks.  Signatures at the
    borders of ranges are put together in a second, small step.
    """
    rows = signed.repartitionByRange(width(signed.sparkSession), "signature", "node").sortWithinPartitions("signature", "node")

    def group(batches):
        first = last = center = None
        for batch in batches:
            sign, node = batch.column("signature").to_numpy(), batch.column("node").to_numpy()
            if not len(sign):
                continue
            first = sign[0] if first is None else first
            new = np.concatenate([[sign[0] != last], sign[1:] != sign[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(sign)), -1))
            low = np.where(at >= 0, node[at], node[0] if center is None else center)
            # a signature that may go on beyond the batch or the range keeps its name; all its rows come here
            border = (sign == first) | (sign == sign[-1])
            inner = ~border & (low != node)
            names = np.concatenate([sign[border], np.zeros(inner.sum(), np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([low[border], low[inner]])), pa.array(np.concatenate([node[border], node[inner]])),
                 pa.array(names, mask=np.arange(len(names)) >= border.sum())], ["center", "member", "signature"])
            last, center = sign[-1], low[-1]

    found = stage(rows.mapInArrow(group, "center long, member long, signature long"), "centers")
    inner = found.filter("signature is null").select("center", "member")
    border = found.filter("signature is not null")
    lowest = border.groupBy("signature").agg(F.min("center").alias("low"))
    outer = border.join(lowest, "signature").select(F.col("low").alias("center"), "member")
    return inner.unionByName(outer).filter("center <> member").distinct()


def groups_of(pairs: DataFrame) -> DataFrame:
    """Rows (center, member) of ``pairs`` and each center as a member of its own group."""
    return pairs.unionByName(pairs.select("center", F.col("center").alias("member")).distinct())


def blocks(members: DataFrame, contents: DataFrame) -> DataFrame:
    """Tasks that bring together all members of each center of ``members`` (center, member).

    ``contents`` has node, weight and columns to carry.  A center's members are
    dealt into blocks of bounded weight by their hash, and each pair of blocks
    is a task of its own, so memory does not grow with the group.  Rows are
    center, low and high (blocks), side (1: of the block ``high``), member and
    the columns carried, those of a task together.
    """
    weights = contents.select(F.col("node").alias("member"), F.expr(f"1 + weight div {WEIGHT}").alias("_w"))
    # a center's members travel by (center, hash), so that no task meets a large group whole
    dealt = members.withColumn("_hash", F.xxhash64("member")).withColumn(
        "_share", F.pmod("_hash", F.lit(width(members.sparkSession))).cast("int"))
    shares = dealt.join(weights.hint("merge"), "member").groupBy("center", "_share").agg(F.sum("_w").alias("_w"))
    totals = shares.groupBy("center").agg(F.ceil(F.sum("_w") / BLOCK).cast("int").alias("blocks"))
    counts = shares.select("center", "_share").join(totals.hint("merge"), "center")
    dealt = dealt.join(counts.hint("merge"), ["center", "_share"]).withColumn(
        "own", F.pmod(F.shiftright("_hash", 20), F.col("blocks")).cast("int"))
    placed = dealt.select("member", "center", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("member", "center", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                           (F.col("own") > F.col("other")).cast("int").alias("side"))
    task = ["center", "low", "high"]
    carried = contents.withColumnRenamed("node", "member").drop("weight")
    return placed.join(carried.hint("merge"), "member").repartition(width(members.sparkSession), *task) \
        .sortWithinPartitions(*task, "side", "member").select(*task, "side", *carried.columns)


def sketches(features: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Odd sketches: bit h of a set tells whether an odd number of its features has hash h.

    A sketch has a power of two of bits, at least 4 for each feature; xor of its
    halves is the sketch of half the bits.  Two sets differ in at least as many
    features as their sketches differ in bits.
    """
    sizes = np.diff(offsets)
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(64, 4 * sizes))).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = mix(features ^ np.uint64(0x94D049BB133111EB)) & (bits[owner] - 1).astype(np.uint64)
    odd = np.packbits(np.bincount(at[owner] + place.astype(np.int64), minlength=at[-1]) & 1)
    return [odd[a // 8:b // 8].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def may_link(sketched: list[bytes], sizes: np.ndarray, left: int, num: int, den: int) -> np.ndarray:
    """Sets that, by their sketches, may be similar to another one (across the sides if ``left`` is below all)."""
    least = min(map(len, sketched))
    rows = []
    for raw in sketched:
        x = np.frombuffer(raw, np.uint8)
        while len(x) > least:
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        rows.append(x)
    x = np.stack(rows).view(np.uint64)
    n = len(x)
    out = np.zeros(n, bool)
    for i in range(left if left < n else n - 1):
        others = np.arange(left if left < n else i + 1, n)
        both = sizes[i] + sizes[others]
        apart = np.bitwise_count(x[others] ^ x[i]).sum(axis=1, dtype=np.int64)
        near = others[(apart * (den + num) <= (den - num) * both) & (num * np.maximum(sizes[i], sizes[others])
                                                                     <= den * np.minimum(sizes[i], sizes[others]))]
        if len(near):
            out[i] = out[near] = True
    return out


def tasks_of(batches, *columns: str):
    """(members, rows of the low block, columns) of each task with two sides to compare, from rows of ``blocks``."""
    task, held, left = None, [], 0

    def close():
        alone = task[1] == task[2]
        if len(held) > 1 and (alone or 0 < left < len(held)):
            yield [h[0] for h in held], len(held) if alone else left, [[h[i] for h in held] for i in range(1, len(columns) + 1)]

    for batch in batches:
        values = [batch.column(c).to_pylist() for c in ("center", "low", "high", "side", "member", *columns)]
        for center, low, high, side, *row in zip(*values, strict=True):
            if (center, low, high) != task:
                if task:
                    yield from ((task[0], t) for t in close())
                task, held, left = (center, low, high), [], 0
            held.append(row)
            left += side == 0
    if task:
        yield from ((task[0], t) for t in close())


def likely(members: DataFrame, contents: DataFrame, shingle_words: int, num: int, den: int) -> DataFrame:
    """The rows of ``members`` whose sketch does not rule out every other member of the group."""

    def describe(batches):
        for batch in batches:
            for low, words in runs_of(batch.column("text")):
                features, offsets = words.sets(shingle_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(low, words.rows), pa.array(np.diff(offsets), pa.int64()),
                     pa.array(sketches(features, offsets), pa.binary())], ["node", "n", "sketch"])

    described = stage(contents.select("node", "text").mapInArrow(describe, "node long, n long, sketch binary"), "sketches")
    rows = blocks(members, described.withColumn("weight", F.expr("n div 16")))

    def compare(batches):
        for center, (names, left, (sizes, sketched)) in tasks_of(batches, "n", "sketch"):
            kept = np.flatnonzero(may_link(sketched, np.array(sizes, np.int64), left, num, den))
            if len(kept):
                yield pa.RecordBatch.from_pydict({"center": pa.array([center] * len(kept), pa.int64()),
                                                  "member": pa.array([names[i] for i in kept], pa.int64())})

    return rows.mapInArrow(compare, "center long, member long").distinct()


def verify(members: DataFrame, contents: DataFrame, shingle_words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among the members of each center, as a spanning forest for each task of ``blocks``."""
    rows = blocks(members, contents)

    def compare(batches):
        for _, (names, left, (texts,)) in tasks_of(batches, "text"):
            sets = []
            for _, words in runs_of(pa.array(texts, pa.string())):
                features, offsets = words.sets(shingle_words)
                sets += [features[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            pairs = linked(sets, left, num, den)
            if pairs:
                yield pa.RecordBatch.from_pydict({"a": pa.array([names[i] for i, _ in pairs], pa.int64()),
                                                  "b": pa.array([names[j] for _, j in pairs], pa.int64())})

    return rows.mapInArrow(compare, "a long, b long").distinct()


def jaccard_classes(docs: DataFrame, shingle_words: int = 5, num: int = 4, den: int = 5, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    Words are lower-cased (A-Z) runs of bytes that are not ASCII white space; a
    text's set holds its runs of ``shingle_words`` words, or the whole text
    when it has fewer.  Texts are linked when their sets have a similarity of
    ``num / den`` or more; ``component_id`` is the smallest id that links
    reach, the text's own included.  A null, empty or blank text has no
    shingles and no links.  A row without id takes no part and has no
    component.  Repeated rows are all returned; rows that share an id are one
    node, with the links of all their texts.  Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def describe(batches):
        import hashlib

        for batch in batches:
            for low, words in runs_of(batch.column("text")):
                features, offsets = words.sets(shingle_words)
                marks = [hashlib.blake2b(features[a:b].tobytes(), digest_size=16).digest() if b > a else None
                         for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, words.rows), pa.array(np.diff(offsets), pa.int64()),
                     pa.array(marks, pa.binary())], ["doc_id", "n_shingles", "mark"])

    described = stage(rows.mapInArrow(describe, "doc_id long, n_shingles long, mark binary"), "sets")
    named = described.filter("doc_id is not null and mark is not null")
    heads = stage(named.groupBy("mark").agg(F.min("doc_id").alias("head")), "heads")

    def sign(batches):
        for batch in batches:
            for low, words in runs_of(batch.column("text")):
                signed, offsets = signatures(*words.sets(shingle_words), num, den)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, words.rows), lists],
                                                 ["doc_id", "signatures"])

    nodes = heads.select(F.col("head").alias("doc_id")).distinct()
    signed = rows.filter("doc_id is not null").mapInArrow(sign, "doc_id long, signatures array<long>")
    signed = signed.join(nodes.hint("merge"), "doc_id", "left_semi").select(
        F.explode("signatures").alias("signature"), F.col("doc_id").alias("node"))
    pairs = stage(together(signed), "pairs")
    needed = pairs.select(F.col("center").alias("doc_id")).unionByName(pairs.select(F.col("member").alias("doc_id"))).distinct()
    contents = rows.join(needed.hint("merge"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("node"), "text").distinct()
    contents = stage(contents, "contents").withColumn("weight", F.expr("octet_length(text) div 6"))
    members = stage(likely(groups_of(pairs), contents, shingle_words, num, den), "likely")
    links = verify(members, contents, shingle_words, num, den)
    # texts under one id: links between the classes that the id joins
    copies = named.join(heads, "mark").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).filter("a <> b").distinct()
    reached = components(links.unionByName(copies))
    return described.join(reached, described.doc_id == reached.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle_words: int = 5, num: int = 4, den: int = 5, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``docs`` with the row of smallest id of each class only; rows without id are kept.

    Rows that share an id are rows of their own: each goes only if its own text
    is in a class with a row before it by (id, size of text), or is repeated
    under its id.
    """
    rows = rows_by_id(docs, key, text)
    classes = jaccard_classes(rows.select("node", F.col("row")[text].alias("text")), shingle_words, num, den, "node")
    gone = classes.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return rows.join(gone.hint("merge"), F.col("node") == F.col("_gone"), "left_anti").select("row.*")
