"""Homomorphic multiset hash of the paragraphs of a document.

A paragraph here is a sentence of a line (at most 32 words of it), without the
white space around it.  Its BLAKE2 digest gives 12 lanes of 32 bits and 128
signs.  A fingerprint is the count of paragraphs and the sum of their lanes
modulo 2^32 and of their signs modulo 2^16.  It does not depend on the order of
the paragraphs, and paragraphs can be added to it or taken from it.  Equal
lanes mean equal multisets but for collisions; the squared distance of the sign
sums estimates by how many paragraphs two multisets differ.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ordered_parts, slices, width

LANES, SIGNS, MOST_WORDS = 12, 128, 32
BYTES = 4 + 4 * LANES + 2 * SIGNS
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SLICE = 6_000_000


def paragraphs(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        for sentence in _SENTENCE.split(line):
            sentence = sentence.strip()
            if len(sentence) < 2 * MOST_WORDS:  # too short to have more words
                if sentence:
                    out.append(sentence)
                continue
            words = sentence.split()
            if len(words) <= MOST_WORDS:
                out.append(sentence)
            else:
                out += [" ".join(words[i:i + MOST_WORDS]) for i in range(0, len(words), MOST_WORDS)]
    return out


class Sums:
    """Fingerprints of many documents as arrays."""

    def __init__(self, count: np.ndarray, lanes: np.ndarray, signs: np.ndarray) -> None:
        self.count, self.lanes, self.signs = count, lanes, signs

    @classmethod
    def of(cls, units: list[list[str]]) -> Sums:
        count = np.array([len(u) for u in units], np.uint32)
        lanes, signs = np.zeros((len(units), LANES), np.uint32), np.zeros((len(units), SIGNS), np.uint16)
        digests = b"".join([hashlib.blake2b(p.encode("utf-8", "surrogatepass")).digest() for u in units for p in u])
        if digests:
            raw = np.frombuffer(digests, np.uint8).reshape(-1, 64)
            some = count > 0
            at = (np.cumsum(count) - count)[some].astype(np.int64)
            lanes[some] = np.add.reduceat(np.ascontiguousarray(raw[:, :4 * LANES]).view("<u4"), at, axis=0)
            up = np.add.reduceat(np.unpackbits(raw[:, 4 * LANES:], axis=1), at, axis=0, dtype=np.uint16)
            signs[some] = up * np.uint16(2) - count[some, None].astype(np.uint16)
        return cls(count, lanes, signs)

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.count + other.count, self.lanes + other.lanes, self.signs + other.signs)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.count - other.count, self.lanes - other.lanes, self.signs - other.signs)

    def __getitem__(self, rows) -> Sums:
        return Sums(self.count[rows], self.lanes[rows], self.signs[rows])

    def strings(self) -> list[str]:
        parts = (self.count.astype("<u4")[:, None], self.lanes.astype("<u4"), self.signs.astype("<u2"))
        raw = np.concatenate([np.ascontiguousarray(p).view(np.uint8).reshape(len(self.count), -1) for p in parts], 1)
        return [bytes(r).hex() for r in raw]

    @classmethod
    def parse(cls, strings: list[str]) -> Sums:
        raw = np.frombuffer(bytes.fromhex("".join(strings)), np.uint8).reshape(-1, BYTES)
        part = lambda a, b, kind: np.ascontiguousarray(raw[:, a:b]).view(kind)
        return cls(part(0, 4, "<u4")[:, 0], part(4, 4 + 4 * LANES, "<u4"), part(4 + 4 * LANES, BYTES, "<u2"))

    def likeness(self, other: Sums) -> np.ndarray:
        """1 - paragraphs that differ / paragraphs of both, estimated, from 0 to 1; 1 if both have none."""
        apart = (self.signs - other.signs).view(np.int16).astype(np.float64)
        differ = (apart * apart).mean(axis=1)
        both = self.count.astype(np.float64) + other.count
        same = (self.count == other.count) & (self.lanes == other.lanes).all(axis=1)
        return np.where(same, 1.0, np.clip(1 - differ / np.maximum(both, 1), 0, 1))


def updated(fingerprint: str, inserted: list[str] = (), deleted: list[str] = ()) -> str:
    """The fingerprint after paragraphs of texts came in or went."""
    take = lambda texts: Sums.of([[p for t in texts for p in paragraphs(t)]])
    return (Sums.parse([fingerprint]) + take(inserted) - take(deleted)).strings()[0]


def _replaced(text: str, following: str) -> str:
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def with_neighbour(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, text, guest, range) sorted in ranges; after each range comes the first row of the next as a guest.

    Ranges follow (key, size, checksum), null keys first, from a sorted light
    table; the first rows of all ranges, one for each partition, are its
    bounds.  Texts are shuffled once.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), content.alias("text"),
                       F.octet_length(content).alias("size"), F.crc32(content).alias("crc"))
    order = ["key", "size", "crc"]
    parts = ordered_parts(rows.select(*order), *order, purpose="ranges")
    firsts = parts.filter("_at = 0").select("_part", *order)
    found = sorted(firsts.collect())  # one row for each partition
    bounds = [(r.key is not None, r.key or 0, r["size"], r.crc) for r in found]

    @F.pandas_udf("int")
    def range_of(present, keys, size, crc):
        import pandas as pd

        return pd.Series([bisect_right(bounds, row) - 1
                          for row in zip(present, keys, size, crc, strict=True)], dtype="int32")

    placed = rows.withColumn("range", range_of(F.col("key").isNotNull(), F.coalesce("key", F.lit(0)), "size", "crc"))
    # a bound equal to the one before it can have no rows of its own; the last of equal bounds takes them all
    starts = {b: i for i, b in enumerate(bounds)}
    taken = sorted(starts.values())
    before = {r: taken[i - 1] for i, r in enumerate(taken)}
    if found:
        table = docs.sparkSession.createDataFrame(
            [(found[i].key, found[i]["size"], found[i].crc, before[i]) for i in taken],
            "b_key long, b_size int, b_crc long, before int")
        same = F.col("key").eqNullSafe(F.col("b_key")) & (F.col("size") == F.col("b_size")) & (F.col("crc") == F.col("b_crc"))
        guests = rows.join(F.broadcast(table), same).dropDuplicates(["key", "size", "crc"]).select(
            "key", "text", "size", "crc", F.col("before").alias("range"))
    else:
        guests = placed.limit(0)
    both = placed.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    return both.repartitionByRange(width(docs.sparkSession), "range").sortWithinPartitions("range", "guest", *order) \
        .select("key", "text", "guest")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has the last quarter of the code points replaced by the
    first as many of the next row's text (after the last row: the first's).
    Its fingerprint is the text's, less the paragraphs from the line of the
    edit on, plus the new ones.  A null text is empty; an empty text has no
    paragraphs, and its edited text is empty.  Equal keys follow size and
    checksum, null keys come first, repeated rows are all returned; other
    columns are not read; an empty table gives no rows.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def results(keys, texts, following, sums, next_sums):
        edited = [_replaced(t, f) for t, f in zip(texts, following, strict=True)]
        lines = [t.rfind("\n", 0, len(t) - len(t) // 4) + 1 for t in texts]
        gone = Sums.of([paragraphs(t[a:]) for t, a in zip(texts, lines, strict=True)])
        come = Sums.of([paragraphs(e[a:]) for e, a in zip(edited, lines, strict=True)])
        after = sums - gone + come
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(keys, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
            "fingerprint": sums.strings(), "edited_fingerprint": after.strings(),
            "near_edited": sums.likeness(after), "near_next": sums.likeness(next_sums)})

    def work(batches):
        held = None  # the last row whose next is not seen yet: (key, text, guest, Sums)
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum(batch.column("size").to_numpy(zero_copy_only=False))]).astype(np.int64)
            for low, high in slices(sizes, _SLICE):
                keys, texts, guest = (batch.column(c).slice(low, high - low).to_pylist() for c in ("key", "text", "guest"))
                sums = Sums.of([paragraphs(t) for t in texts])
                if held:
                    keys, texts, guest = [held[0], *keys], [held[1], *texts], [held[2], *guest]
                    sums = Sums(*(np.concatenate([a, b]) for a, b in zip(
                        (held[3].count, held[3].lanes, held[3].signs), (sums.count, sums.lanes, sums.signs), strict=True)))
                own = [i for i in range(len(keys) - 1) if not guest[i]]
                if own:
                    after = [i + 1 for i in own]
                    yield results([keys[i] for i in own], [texts[i] for i in own], [texts[i] for i in after],
                                  sums[own], sums[after])
                held = (keys[-1], texts[-1], guest[-1], sums[[-1]])

    shape = ", ".join(f"{n} {t}" for n, t in zip(names, ("long", "long", "string", "string", "string", "double", "double"),
                                                 strict=True))
    return with_neighbour(docs, key, text).withColumn("size", F.octet_length("text").cast("long")).mapInArrow(work, shape)
