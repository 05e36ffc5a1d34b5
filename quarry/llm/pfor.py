"""Token files of patched frame-of-reference blocks.

A file is a table of segments, one row each, which Spark's Parquet writer
commits to any store; the payload of a segment is, little-endian:

    "QPF1", documents u32, blocks u32, tokens u64
    key of each document i64, key present u8, tokens of each document u32
    start of each block u32 (from the first block), and the end of the last
    blocks of 128 ids: minimum u32, width u8, exceptions u8,
        128 offsets from the minimum cut to `width` bits, high bit first,
        place of each exception u8, what its offset has above `width` u32

The last block is filled up with its minimum.  Documents follow one another
without gaps, so document d begins in block (ids before d) div 128.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import part_bases, width
from quarry.llm.tokens import encoder

BLOCK = 128
HEAD = np.dtype([("magic", "S4"), ("docs", "<u4"), ("blocks", "<u4"), ("tokens", "<u8")])
SEGMENT = "part int, segment int, first_id long, documents long, tokens long, start_in_part long, payload binary"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of each value."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack_blocks(ids: np.ndarray, percentile: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, start of each block and the end) of an array of ids below 2**32.

    A block's width holds its offset at ``percentile``; larger ones are exceptions.
    """
    n = -(-len(ids) // BLOCK)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.uint32)
    full = np.empty(n * BLOCK, np.uint32)
    full[:len(ids)] = ids
    full[len(ids):] = ids[(n - 1) * BLOCK:].min()
    full = full.reshape(n, BLOCK)
    low = full.min(axis=1)
    offset = full - low[:, None]
    rank = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    wide = _bits(np.partition(offset, rank, axis=1)[:, rank])
    above = (offset.astype(np.uint64) >> wide[:, None].astype(np.uint64)).astype(np.uint32)
    odd = above != 0
    exceptions = odd.sum(axis=1)
    start = np.concatenate([[0], np.cumsum(6 + BLOCK // 8 * wide + 5 * exceptions)])
    out = np.zeros(start[-1], np.uint8)
    for i in range(4):
        out[start[:-1] + i] = (low >> np.uint32(8 * i)) & 0xFF
    out[start[:-1] + 4] = wide
    out[start[:-1] + 5] = exceptions
    for w in np.unique(wide[wide > 0]):
        rows = np.flatnonzero(wide == w)
        bits = np.unpackbits(offset[rows].astype(">u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2)
        packed = np.packbits(bits[:, :, 32 - w:].reshape(len(rows), -1), axis=1)
        out[(start[rows] + 6)[:, None] + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(odd)
    nth = np.arange(len(block)) - (np.cumsum(exceptions) - exceptions)[block]
    at = start[block] + 6 + BLOCK // 8 * wide[block]
    out[at + nth] = place
    high = above[block, place]
    for i in range(4):
        out[at + exceptions[block] + 4 * nth + i] = (high >> np.uint32(8 * i)) & 0xFF
    return out, start.astype(np.uint32)


def unpack_blocks(data: np.ndarray, start: np.ndarray, count: int) -> np.ndarray:
    """The ids that ``pack_blocks`` packed."""
    start = start.astype(np.int64)
    n = len(start) - 1
    if n == 0:
        return np.zeros(0, np.uint32)
    low = sum(data[start[:-1] + i].astype(np.uint32) << np.uint32(8 * i) for i in range(4))
    wide, exceptions = data[start[:-1] + 4].astype(np.int64), data[start[:-1] + 5].astype(np.int64)
    offset = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(wide[wide > 0]):
        rows = np.flatnonzero(wide == w)
        packed = data[(start[rows] + 6)[:, None] + np.arange(BLOCK // 8 * w)]
        bits = np.zeros((len(rows), BLOCK, 32), np.uint8)
        bits[:, :, 32 - w:] = np.unpackbits(packed, axis=1).reshape(len(rows), BLOCK, w)
        offset[rows] = np.packbits(bits, axis=2).view(">u4").reshape(len(rows), BLOCK)
    block = np.repeat(np.arange(n), exceptions)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    at = start[block] + 6 + BLOCK // 8 * wide[block]
    place = data[at + nth]
    high = sum(data[at + exceptions[block] + 4 * nth + i].astype(np.uint64) << np.uint64(8 * i) for i in range(4)) \
        if len(block) else np.zeros(0, np.uint64)
    offset[block, place] |= (high << wide[block].astype(np.uint64)).astype(np.uint32)
    return (offset + low[:, None]).reshape(-1)[:count]


def write_segment(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray, percentile: float) -> bytes:
    data, start = pack_blocks(ids, percentile)
    head = np.array([(b"QPF1", len(keys), len(start) - 1, len(ids))], HEAD)
    return b"".join([head.tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(),
                     np.array([k is not None for k in keys], "u1").tobytes(), lengths.astype("<u4").tobytes(),
                     start.astype("<u4").tobytes(), data.tobytes()])


def read_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(keys, tokens of each document, ids) of a segment."""
    head = np.frombuffer(payload, HEAD, 1)[0]
    if head["magic"] != b"QPF1":
        raise ValueError("not a token segment")
    docs, at, parts = int(head["docs"]), HEAD.itemsize, []
    for kind, n in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", int(head["blocks"]) + 1)):
        parts.append(np.frombuffer(payload, kind, n, at))
        at += parts[-1].nbytes
    keys, present, lengths, start = parts
    ids = unpack_blocks(np.frombuffer(payload, np.uint8, offset=at), start, int(head["tokens"]))
    return [int(k) if p else None for k, p in zip(keys, present, strict=True)], lengths.astype(np.int64), ids


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, key: str = "doc_id",
                 text: str = "text", segment_tokens: int = 500_000, percentile: float = 0.9) -> None:
    """Encode the texts of ``docs`` in ascending ``key`` order and write them as token segments to ``path``.

    Each document's ids end with ``end_id``; a null or empty text is that id
    alone.  Rows are sorted into ranges by key (null first), then size and
    checksum, so a repeated key spreads over ranges and a rerun task meets the
    same rows.  A segment closes after the document with which it reaches
    ``segment_tokens``; documents are never cut.  An empty table gives an empty
    one.  Other columns are not read.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), content.alias("text"),
                       F.octet_length(content).alias("size"), F.crc32(content).alias("crc"))
    order = ["key", "size", "crc"]
    dealt = rows.repartitionByRange(width(docs.sparkSession), *order).sortWithinPartitions(*order)

    def encode(batches):
        part, segment, done = TaskContext.get().partitionId(), 0, 0
        keys, lengths, ids, held = [], [], [], 0

        def close():
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_pydict(
                {"part": [part], "segment": [segment], "first_id": [keys[0]], "documents": [len(keys)],
                 "tokens": [len(flat)], "start_in_part": [done],
                 "payload": [write_segment(keys, np.array(lengths), flat, percentile)]}, schema=layout)

        for batch in batches:
            ids_of = batch.column("key").to_pylist()
            for low, found, counts in encoder(vocabulary).encode(batch.column("text")):
                at = np.concatenate([[0], np.cumsum(counts)])
                ended = np.insert(found, at[1:], end_id).astype(np.uint32)
                at = at + np.arange(len(at))
                for i, n in enumerate(counts + 1):
                    keys.append(ids_of[low + i])
                    lengths.append(int(n))
                    ids.append(ended[at[i]:at[i + 1]])
                    held += int(n)
                    if held >= segment_tokens:
                        yield close()
                        segment, done = segment + 1, done + held
                        keys, lengths, ids, held = [], [], [], 0
        if keys:
            yield close()

    layout = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()),
                        ("documents", pa.int64()), ("tokens", pa.int64()), ("start_in_part", pa.int64()),
                        ("payload", pa.binary())])
    dealt.select("key", "text").mapInArrow(encode, SEGMENT).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a token file: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    bases = part_bases(segments.select(F.col("part").alias("_part"), F.lit(0).alias("_at"), "tokens"), F.col("tokens"))
    placed = segments.join(F.broadcast(bases.select(F.col("_part").alias("part"), "_base")), "part")

    def decode(batches):
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                keys, lengths, ids = read_segment(payload.as_buffer())
                at = np.concatenate([[0], np.cumsum(lengths)])
                raw = ids.astype("<u4")
                out = {"doc_id": pa.array(keys, pa.int64()), "start": pa.array(start + at[:-1]),
                       "n_tokens": pa.array(lengths), "ids_crc32": pa.array(
                           [zlib.crc32(raw[a:b].data) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return placed.select((F.col("_base") + F.col("start_in_part")).alias("start"), "payload").mapInArrow(decode, shape)
