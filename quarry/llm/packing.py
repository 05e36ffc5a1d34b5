"""Documents packed into training windows of several lengths."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tokens import encoder

SHAPE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
         "window int, step_id long")


class Packer:
    """Packs pieces of documents into full windows, longest tier first.

    A piece is (length, order of arrival, document, start).  A document's full
    longest windows are its own; the rest is routed to the shortest tier that
    holds it.  A window opens with the longest waiting piece of its tier; the
    gap takes the longest waiting shorter pieces that fit, and at last the
    front of the shortest piece that is too long, so that the window is full.
    """

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers = sorted(tiers)
        self.longest = self.tiers[-1]
        self.waiting: list[tuple[int, int, int, int]] = []  # sorted by length
        self.tokens = 0
        self.arrived = 0
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def _put(self, length: int, document: int, start: int) -> None:
        if length in self.tiers:
            self.windows.append((length, [(document, start, length)]))
        elif length:
            self.arrived += 1
            insort(self.waiting, (length, self.arrived, document, start))
            self.tokens += length

    def add(self, document: int, length: int) -> None:
        whole = length // self.longest * self.longest
        for start in range(0, whole, self.longest):
            self.windows.append((self.longest, [(document, start, self.longest)]))
        self._put(length - whole, document, whole)

    def _take(self, at: int) -> tuple[int, int, int, int]:
        piece = self.waiting.pop(at)
        self.tokens -= piece[0]
        return piece

    def _fill(self, window: int) -> None:
        """One full window from waiting pieces, which hold at least so many tokens."""
        length, _, document, start = self._take(bisect_right(self.waiting, (window, self.arrived + 1, 0, 0)) - 1)
        inside, gap = [(document, start, length)], window - length
        while gap:
            at = bisect_right(self.waiting, (gap, self.arrived + 1, 0, 0)) - 1
            if at >= 0:
                length, _, document, start = self._take(at)
                inside.append((document, start, length))
                gap -= length
            else:
                length, _, document, start = self._take(0)
                inside.append((document, start, gap))
                self._put(length - gap, document, start + gap)
                gap = 0
        self.windows.append((window, inside))

    def flush(self, last: bool) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Full windows of all tiers; at the last call also windows for the binary digits of the remaining tokens."""
        for tier, below in zip(self.tiers[::-1], [*self.tiers[-2::-1], 0], strict=True):
            while self.tokens >= tier:
                at = bisect_right(self.waiting, (tier, self.arrived + 1, 0, 0)) - 1
                if at < 0 or self.waiting[at][0] <= below:
                    break
                self._fill(tier)
        while last and self.tokens:
            # the largest power of two that fits, cut from the longest pieces
            size = min(self.longest, 1 << (self.tokens.bit_length() - 1))
            inside, gap = [], size
            while gap:
                length, _, document, start = self._take(len(self.waiting) - 1)
                used = min(length, gap)
                inside.append((document, start, used))
                if length > used:
                    self.arrived += 1
                    insort(self.waiting, (length - used, self.arrived, document, start + used))
                    self.tokens += length - used
                gap -= used
            self.windows.append((size, inside))
        out, self.windows = self.windows, []
        return out


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each window, so that groups have like numbers of tokens and like mixtures of window lengths."""
    groups = [(0, 0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        tokens, cost, g = heapq.heappop(groups)
        out[i] = g
        heapq.heappush(groups, (tokens + sizes[i], cost + sizes[i] * sizes[i], g))
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, tiers: tuple[int, ...] = (256, 512, 1024, 2048),
         step_tokens: int = 16_384, hold_tokens: int = 1_000_000, key: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """Pieces of the encoded documents of ``docs`` with their place in training windows.

    Each task packs the rows of its own partition, so nothing is shuffled.
    Every document is its ids and ``end_id`` (null or empty text: that id
    alone).  Windows of all tiers are packed full, so none has padding; once
    ``hold_tokens`` wait they are packed and memory is bounded by that and one
    batch.  Tokens left at the end of a partition fill windows of the powers of
    two that add up to them.  ``step_id`` groups windows into steps of about
    ``step_tokens`` with the same mixture of lengths.  Ids are unique over
    partitions.  Rows with equal or null keys are documents of their own; other
    columns are not read; an empty table gives no rows.  Partitions must hold
    the same rows in the same order when a task is run again, as a table read
    from files does.
    """
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two")

    def work(batches):
        first = TaskContext.get().partitionId() << 40
        packer, held, sequences, steps, n = Packer(tiers), {}, 0, 0, 0

        def emit(windows):
            nonlocal sequences, steps
            groups = step_groups([w for w, _ in windows], step_tokens)
            rows = []
            for (window, inside), group in zip(windows, groups, strict=True):
                offset = 0
                for document, start, length in inside:
                    name, ids = held[document]
                    piece = ids[start:start + length]
                    rows.append((name, start, length, zlib.crc32(piece.data), len(ids), first + sequences, offset,
                                 window, first + steps + group, *([piece] if with_ids else [])))
                    offset += length
                sequences += 1
            steps += max(groups, default=-1) + 1
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            keys = batch.column("key").to_pylist()
            for low, found, counts in encoder(vocabulary).encode(batch.column("text")):
                at = np.concatenate([[0], np.cumsum(counts)])
                ended = np.insert(found, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                for i in range(len(counts)):
                    held[n] = (keys[low + i], ended[at[i]:at[i + 1]])
                    packer.add(n, int(at[i + 1] - at[i]))
                    n += 1
                if packer.tokens >= hold_tokens or sum(w for w, _ in packer.windows) >= hold_tokens:
                    windows = packer.flush(False)
                    if windows:
                        yield emit(windows)
                    held = {d: (held[d][0], held[d][1].copy()) for d in {p[2] for p in packer.waiting}}
        windows = packer.flush(True)
        if windows:
            yield emit(windows)

    names = [f.split()[0] for f in SHAPE.split(", ")] + ["ids"] * with_ids
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(work, SHAPE + ", ids array<long>" * with_ids)
