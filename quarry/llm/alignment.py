"""Links between the tokens of two tokenizers over the same texts.

Both tokenizers write one byte sequence, so a text is two sorted lists of
token ends.  Merging the lists gives its segments: the stretches between two
neighbouring ends.  A segment lies in one token of each side and is one link,
as two tokens overlap in one stretch.  Ends that both sides have cut the text
into groups.

The merge is divided by the merge path: the k-th diagonal of the grid of the
two lists holds all ways to have taken k ends from both; a binary search on it
finds the one that the sorted order takes.  Cuts at every ``PIECE`` ends give
pieces of equal work that need nothing of each other.  Each emits the links of
its ends and the groups that close in it; a group that reaches past a border is
stitched from the parts that the pieces hold.

Tokens never reach across a space that stands between two visible characters,
so texts are cut there, and equal chunks are encoded and merged once in a
worker.  Texts with other white space at a chunk's border are one chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.rows import unnest
from quarry.llm.common import slices, stage, text_buffer
from quarry.llm.tokens import vocabulary_file

PIECE = 4096  # ends in a piece of a merge
SLICE = 3_000_000  # bytes of text worked on at a time
KNOWN = 300_000  # chunks whose links a worker keeps; others are made again
BLOCK = 2_000_000  # counted pairs that travel to the tasks at once (26 MB)
SHIFT = 1 << 15  # a pair of ids is one number: a * SHIFT + b
SPACE_AT_BORDER = (r"^$|^[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
                   r"|[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]$"
                   r"|\x{2581}")


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Cuts (ends taken of ``a``, of ``b``) of the merge of two sorted lists at every ``piece`` ends; a's come first on ties.

    One binary search for each diagonal, all of them side by side.
    """
    total = len(a) + len(b)
    k = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(0, k - len(b)), np.minimum(k, len(a))
    while True:
        open_ = low < high
        if not open_.any():
            return low, k - low
        mid = (low + high) // 2
        before = np.zeros(len(k), bool)  # whether a[mid] comes before b[k - mid - 1]
        before[open_] = a[mid[open_]] <= b[(k - mid - 1)[open_]]
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)


def merge_piece(a: np.ndarray, b: np.ndarray, cut: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one piece: (token of a, token of b, whether both end here) for each segment that ends in it.

    ``cut`` is (first end of a, past its last, first of b, past its last).  An
    end that both lists hold counts as one, in the piece that takes it from a.
    """
    a0, a1, b0, b1 = cut
    ends = np.concatenate([a[a0:a1], b[b0:b1]])
    from_a = np.arange(len(ends)) < a1 - a0
    order = np.argsort(ends, kind="stable")  # a's first on ties
    ends, from_a = ends[order], from_a[order]
    token_a = a0 + np.cumsum(from_a) - from_a  # ends taken of each side before this one
    token_b = b0 + np.cumsum(~from_a) - ~from_a
    # an end of a that b has too: b's is the next one of b
    both = from_a & (token_b < len(b)) & (b[np.minimum(token_b, len(b) - 1)] == ends)
    # an end of b that a has too was counted with a's
    again = ~from_a & (token_a > 0) & (a[np.maximum(token_a - 1, 0)] == ends)
    return token_a[~again], token_b[~again], both[~again]


def align(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All segments of two lists of ends with the same last end: (token of a, token of b, whether a group ends here)."""
    at_a, at_b = diagonals(a, b, piece)
    parts = [merge_piece(a, b, cut) for cut in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:], strict=True)]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker and pair of vocabularies."""
    return Aligner(path_a, path_b)


class Aligner:
    """Links of chunks of text under a byte-level vocabulary file and a sentence-piece model."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        # Byte-level entries write bytes 33-126, 161-172, 174-255 as themselves and the others, in turn, from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
        names = self.a.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in of]) for of in (self.bytes_a, self.bytes_b))
        if max(len(self.bytes_a) * SHIFT, len(self.bytes_b)) >= 1 << 31 or len(self.bytes_b) > SHIFT:
            raise ValueError("the vocabularies are too large for a pair in 31 bits")
        self.known, self.table, self.texts = pa.array([], pa.string()), _Links.none(), []

    def chunks(self, chunks: list[str]) -> tuple[_Links, list[str | None]]:
        """Links of each chunk (a space goes in front), and its groups as text; None where the bytes differ."""
        ids_a = [e.ids for e in self.a.encode_batch([" " + c for c in chunks], add_special_tokens=False)]
        ids_b = self.b.encode(chunks, num_threads=1) if chunks else []
        same = []
        for i, c in enumerate(chunks):
            whole = (" " + c).encode()
            same.append(b"".join([self.bytes_a[t] for t in ids_a[i]]) == whole
                        and b"".join([self.bytes_b[t] for t in ids_b[i]]) == whole)
        na = np.array([len(x) if s else 0 for x, s in zip(ids_a, same, strict=True)], np.int64)
        nb = np.array([len(x) if s else 0 for x, s in zip(ids_b, same, strict=True)], np.int64)
        flat = lambda ids: np.array([t for x, s in zip(ids, same, strict=True) if s for t in x], np.int64)
        a, b = flat(ids_a), flat(ids_b)
        if not len(a):
            return _Links.empty(len(chunks)), ["" if s else None for s in same]
        # all chunks as one text: their last ends are ends of both sides, so no link or group crosses them
        at_a, at_b, closes = align(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        owner = np.repeat(np.arange(len(chunks)), na)[at_a]
        links = _Links(na, nb, np.bincount(owner, closes, len(chunks)).astype(np.int64),
                       np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(chunks)))]), a[at_a] * SHIFT + b[at_b])
        return links, self._texts(a, b, at_a[closes], at_b[closes], owner[closes], same)

    @staticmethod
    def _texts(a, b, last_a, last_b, owner, same) -> list[str | None]:
        """The groups of each chunk, written out."""
        a, b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        parts: list[list[str]] = [[] for _ in same]
        from_a = from_b = 0
        for i, j, o in zip((last_a + 1).tolist(), (last_b + 1).tolist(), owner.tolist(), strict=True):
            parts[o].append(f"{','.join(a[from_a:i])}|{','.join(b[from_b:j])}")
            from_a, from_b = i, j
        return [";".join(p) if s else None for p, s in zip(parts, same, strict=True)]

    def lookup(self, chunks: pa.Array) -> tuple[_Links, list[str | None]]:
        """As :meth:`chunks` for distinct chunks; new ones are kept while there is room."""
        found = pc.index_in(chunks, value_set=self.known)
        missing = pc.filter(chunks, pc.is_null(found))
        new, texts = self.chunks(missing.to_pylist())
        place = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(missing))
        both, all_texts = self.table.plus(new), [*self.texts, *texts]
        if len(missing) and len(self.known) < KNOWN:
            self.known, self.table, self.texts = pa.concat_arrays([self.known, missing]), both, all_texts
        return both.take(place), [all_texts[i] for i in place.tolist()]


class _Links:
    """For a list of chunks: tokens of a, of b, groups, and pairs of ids one after another with their offsets."""

    def __init__(self, a, b, groups, offsets, pairs) -> None:
        self.a, self.b, self.groups, self.offsets, self.pairs = a, b, groups, offsets, pairs

    @classmethod
    def empty(cls, n: int) -> _Links:
        return cls(*(np.zeros(n, np.int64) for _ in range(3)), np.zeros(n + 1, np.int64), np.zeros(0, np.int64))

    @classmethod
    def none(cls) -> _Links:
        return cls.empty(0)

    def plus(self, other: _Links) -> _Links:
        if not len(other.a):
            return self
        join = lambda x, y: np.concatenate([x, y])
        return _Links(join(self.a, other.a), join(self.b, other.b), join(self.groups, other.groups),
                      join(self.offsets, self.offsets[-1] + other.offsets[1:]), join(self.pairs, other.pairs))

    def take(self, at: np.ndarray) -> _Links:
        n = np.diff(self.offsets)[at]
        edges = np.concatenate([[0], np.cumsum(n)])
        from_ = np.repeat(self.offsets[at] - edges[:-1], n) + np.arange(edges[-1])
        return _Links(self.a[at], self.b[at], self.groups[at], edges, self.pairs[from_])


def _slice(tools: Aligner, texts: pa.Array) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts: (tokens of a, b, groups, links) by text, digests, and (text, pair, times) of distinct pairs."""
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    split = lists.values.slice(lists.offsets[0].as_py(), offsets[-1]).cast(pa.string()).dictionary_encode()
    index, words = split.indices.to_numpy(), split.dictionary
    odd = pc.match_substring_regex(words, SPACE_AT_BORDER).to_numpy(zero_copy_only=False)
    whole = np.zeros(len(texts), bool)
    whole[owner[odd[index]]] = True
    own = pc.filter(texts, pa.array(whole)).cast(pa.string())
    keep = ~whole[owner]
    used, index = np.unique(index[keep], return_inverse=True)
    table, groups = tools.lookup(words.take(pa.array(used)))
    mine, my_groups = tools.chunks([t or "" for t in own.to_pylist()])
    table, groups = table.plus(mine), groups + my_groups
    full = np.zeros(len(owner), np.int64)  # the chunk of each piece
    full[keep] = index
    counts = np.where(whole, 1, np.diff(offsets))  # chunks of each text; a whole text is one
    starts = np.concatenate([[0], np.cumsum(counts)])
    order = np.zeros(starts[-1], np.int64)
    text_of = np.repeat(np.arange(len(texts)), counts)
    order[~whole[text_of]] = full[keep]
    order[starts[:-1][whole]] = len(used) + np.arange(int(whole.sum()))
    bad = np.array([g is None for g in groups], bool)
    blank = (pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) == 0)
    blank |= np.bincount(text_of, bad[order], len(texts)) > 0
    digests = []
    for i in range(len(texts)):
        if blank[i]:
            digests.append("")
        else:
            joined = ";".join([groups[c] for c in order[starts[i]:starts[i + 1]].tolist()])
            digests.append(hashlib.sha256(joined.encode()).hexdigest())
    order, text_of = order[~blank[text_of]], text_of[~blank[text_of]]
    all_ = table.take(order)
    links = np.diff(all_.offsets)
    sums = [np.bincount(text_of, x, len(texts)).astype(np.int64) for x in (all_.a, all_.b, all_.groups, links)]
    pairs, times = np.unique((np.repeat(text_of, links) << 31) + all_.pairs, return_counts=True)
    return sums, digests, pairs >> 31, pairs & ((1 << 31) - 1), times


MADE = ("row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>")


def links(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row, staged: row, key, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs of ids with their times.

    A pair (a, b) is the number a * SHIFT + b.  Rows whose text is null or
    empty, or whose bytes a tokenizer changes, have zeros, no pairs and an
    empty digest.
    """
    kind = docs.schema[key].dataType
    key_type = to_arrow_type(kind)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(path_a, path_b)
        schema = pa.schema([("row", pa.int64()), ("key", key_type), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")),
                            ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
        for batch in batches:
            texts = batch.column(2).cast(pa.large_string()).fill_null("")
            for low, high in slices(text_buffer(texts)[1], SLICE):
                sums, digests, of, pairs, times = _slice(tools, texts.slice(low, high - low))
                at = pa.array(np.searchsorted(of, np.arange(high - low + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low),
                     *(pa.array(s) for s in sums), pa.array(digests, pa.string()), *lists], schema=schema)
                pa.default_memory_pool().release_unused()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    shape = MADE.replace("row long", f"row long, key {kind.simpleString()}")
    return stage(rows.mapInArrow(made, shape), "links")


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, links, best): links of each pair of ids over all rows, and whether no pair of its b has more."""
    each = unnest(made, F.arrays_zip("pairs", "times"), "x", keep=[]).select("x.pairs", "x.times")
    counts = stage(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").cast("long").alias("links")), "pairs")
    b = F.col("pair") % SHIFT
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.join(most, b == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, key: str = "doc_id",
                    text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link joins two token occurrences that share bytes.  ``count_sum`` adds up,
    over the row's links, the links of the same pair of ids in all rows;
    ``n_best`` counts links whose pair has the most links of all pairs with its
    b (ties included).

    Texts that are null, empty, or changed by a tokenizer give zeros and an empty
    digest.  Null and repeated keys are rows of their own; other columns are not
    read.  The counted pairs are as many as the two vocabularies allow, however
    large the corpus; they travel to the tasks in blocks of ``block``, and each
    block adds its part to the sums of every row.
    """
    made = links(docs, path_a or vocabulary_file("byte_bpe_50k.json"), path_b or vocabulary_file("piece_bpe_32k.model"),
                 key, text)
    counts = stage(pair_counts(made).repartitionByRange("pair").sortWithinPartitions("pair"), "counts")
    total = counts.count()
    shares = [i * block / total for i in range(1, -(-total // block))]
    cuts = counts.select(F.percentile_approx("pair", shares)).first()[0] if shares else []
    edges, parts = [None, *cuts, None], None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = counts
        part = part if low is None else part.filter(F.col("pair") > low)
        part = part if high is None else part.filter(F.col("pair") <= high)
        sums = _sums(made.select("row", "pairs", "times"), part)
        parts = sums if parts is None else parts.unionByName(sums)
    if len(edges) > 2:
        parts = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    kept = made.drop("pairs", "times").join(parts, "row", "left")
    return kept.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links",
                       F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
                       "groups_sha256")


def _sums(made: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of the pairs in ``counts``, which fits into a task."""
    table = counts.orderBy("pair").toArrow()
    given = made.sparkSession.sparkContext.broadcast(tuple(
        table.column(c).to_numpy().astype(t) for c, t in (("pair", np.int32), ("links", np.int64), ("best", bool))))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = given.value
        for batch in batches:
            lists, of_times = batch.column(1), batch.column(2)
            at = lists.offsets.to_numpy()
            mine, times = lists.flatten().to_numpy(), of_times.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(batch)), np.diff(at))
            sums = np.zeros((2, len(batch)), np.int64)
            if len(pair) and len(mine):
                place = np.minimum(np.searchsorted(pair, mine), len(pair) - 1)
                here = pair[place] == mine
                value = np.where(here, n[place] * times, 0)
                good = np.where(here & best[place], times, 0)
                edge = np.concatenate([[0], np.cumsum(value)])
                sums[1] = edge[at[1:] - at[0]] - edge[at[:-1] - at[0]]
                sums[0] = np.bincount(owner, good, len(batch)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1])],
                                             names=["row", "n_best", "count_sum"])

    return made.mapInArrow(added, "row long, n_best long, count_sum long")
