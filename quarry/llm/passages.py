"""Removal of passages that repeat across documents.

Paragraphs (lines, and blocks of lines between blank lines): equal sets of shingles are joined at once under the first
of them; bands of the MinHash of one paragraph of each set bring documents
together, whose paragraphs are verified by the exact Jaccard similarity.

Passages inside paragraphs: anchors, positions whose shingle is the smallest of
a window, are chosen alike by all documents of a passage wherever it stands.
Runs of 50 words around anchors whose next 25 words another document has are
sorted by their hashes, and each goes unless its document has the smallest id.
This is work in proportion to the shared words, however many documents share
a passage.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quarry.llm.common import Folders, stage, width
from quarry.llm.components import components
from quarry.llm.partenum import blocks, groups_of, linked, tasks_of, together
from quarry.llm.words import Words, mix, runs_of

SHINGLE, RUN, WINDOW, AFTER = 5, 50, 24, 25  # words of a shingle, of a run; shingles of a window; words after an anchor
BANDS, ROWS = 10, 4  # 1 - (1 - 0.8 ** 4) ** 10 = 0.995 of the paragraph pairs at similarity 0.8
_ODD = [np.uint64(pow(0x9DDFEA08EB382D69, j + 1, 1 << 64) | 1) for j in range(RUN)]
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def _stretch(shingles: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Hashes of runs of ``words`` words (a multiple of a shingle's) that begin at shingles ``at``."""
    total = np.zeros(len(at), np.uint64)
    for j in range(0, words, SHINGLE):
        total += shingles[at + j] * _ODD[j]
    return mix(total)


def _whole(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of full length, by their first word, and for each word whether one begins there."""
    hashes, first = words.shingles(SHINGLE)
    full = words.count[words.text[first]] >= SHINGLE
    out = np.zeros(len(words.hash), np.uint64)
    begins = np.zeros(len(words.hash), bool)
    out[first[full]], begins[first[full]] = hashes[full], True
    return out, begins


def _anchors(shingles: np.ndarray, text: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """First words of the smallest shingle (the first of equals) of every window of a text."""
    n = len(shingles)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    start = np.arange(n - WINDOW + 1)
    fine = (text[start] == text[start + WINDOW - 1]) & begins[start + WINDOW - 1]
    chosen = [np.zeros(0, np.int64)]
    for low in range(0, len(start), 1 << 16):
        part = start[low:low + (1 << 16)][fine[low:low + (1 << 16)]]
        if len(part):
            view = np.lib.stride_tricks.sliding_window_view(shingles, WINDOW)
            chosen.append(np.unique(part + view[part].argmin(axis=1)))
    return np.unique(np.concatenate(chosen))


def _spans(words: Words, raw: np.ndarray) -> list[tuple[int, int]]:
    """First word and end of each line and of each block of lines; a text without a blank line has no blocks."""
    if not len(words.start):
        return []
    breaks = np.cumsum(raw == 10)
    line = breaks[words.start]
    other = words.text[1:] != words.text[:-1]
    apart = line[1:] - line[:-1]
    blank = np.zeros(words.rows, bool)
    blank[words.text[1:][(apart > 1) & ~other]] = True
    out = set()
    for lines in (1, 2):
        first = np.flatnonzero(np.concatenate([[True], (apart >= lines) | other]))
        ends = np.append(first[1:], len(words.start))
        kept = (lines == 1) | blank[words.text[first]]
        out.update(zip(first[kept].tolist(), ends[kept].tolist(), strict=True))
    return sorted(out)


def _least(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of the shingles under each seed."""
    out = np.full(len(_SEEDS), ~np.uint64(0))
    for low in range(0, len(shingles), 4096):
        out = np.minimum(out, mix(shingles[None, low:low + 4096] ^ _SEEDS[:, None]).min(axis=1))
    return out


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First words of the anchors of the texts that have ``AFTER`` words from there, and the hashes of these words."""
    shingles, begins = _whole(words)
    at = _anchors(shingles, words.text, begins)
    last = at + AFTER - SHINGLE
    fine = last < len(shingles)
    fine[fine] = (words.text[at[fine]] == words.text[last[fine]]) & begins[last[fine]]
    at = at[fine]
    return at, _stretch(shingles, at, AFTER)


def _starts(words: Words) -> np.ndarray:
    """First word of each text, and the number of words."""
    return np.searchsorted(words.text, np.arange(words.rows + 1))


def _paragraphs(words: Words, least_words: int):
    """(text, start, end, set) of each paragraph (line or block) of enough words; start and end are code points of its text."""
    shingles, _ = _whole(words)
    points = _code_points(words.data)
    base = points[words.offsets[:-1]]
    for a, b in _spans(words, words.data):
        if b - a >= least_words:
            text = int(words.text[a])
            yield (text, int(points[words.start[a]] - base[text]), int(points[words.end[b - 1]] - base[text]),
                   np.unique(shingles[a:b - SHINGLE + 1]))


def bands(features: np.ndarray) -> np.ndarray:
    """Hashes of the bands of a set's MinHash."""
    low = _least(features).reshape(BANDS, ROWS)
    return mix((low * _ODD[1:ROWS + 1]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[9])


def _code_points(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte of UTF-8."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


def _compare(names: list[int], left: int, texts: list[str], least_words: int, num: int, den: int):
    """Links between similar paragraphs (doc_id, start, end) of a task; with ``left`` < texts, only across the sides."""
    paragraphs, sets, sides = [], [], []
    for low, words in runs_of(pa.array(texts, pa.string())):
        for text, start, end, features in _paragraphs(words, least_words):
            paragraphs.append((names[text + low], start, end))
            sets.append(features)
            sides.append(text + low >= left)
    order = sorted(range(len(sets)), key=lambda i: sides[i])
    n_left = len(sets) if left >= len(texts) else len(sets) - sum(sides)
    if len(sets) < 2 or not n_left or (left < len(texts) and n_left == len(sets)):
        return []
    pairs = linked([sets[i] for i in order], n_left, num, den, [paragraphs[i][0] for i in order])
    return [(paragraphs[order[i]], paragraphs[order[j]]) for i, j in pairs]


def similar_paragraphs(rows: DataFrame, least_words: int, num: int, den: int) -> DataFrame:
    """``doc_id, start, end, keeper_id`` of paragraphs that are linked to one of a smaller id."""
    with Folders().collecting() as mine:
        reached = _linked_paragraphs(rows, least_words, num, den)
        mine.release(rows.sparkSession, reached)  # the components are written; nothing reads the rest again
    return reached.filter("node <> component").select(
        "node.doc_id", "node.start", "node.end", F.col("component.doc_id").alias("keeper_id")).filter("doc_id <> keeper_id")


def _linked_paragraphs(rows: DataFrame, least_words: int, num: int, den: int) -> DataFrame:
    """(node, component) of the linked paragraphs, each (doc_id, start, end)."""

    def sign(batches):
        for batch in batches:
            for low, words in runs_of(batch.column("text")):
                names = batch.column("doc_id").slice(low, words.rows).to_pylist()
                found = [(names[t], a, b, hashlib.blake2b(f.tobytes(), digest_size=16).digest(), bands(f).view(np.int64))
                         for t, a, b, f in _paragraphs(words, least_words)]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)],
                        ["doc_id", "start", "end", "mark", "bands"])

    found = stage(rows.mapInArrow(sign, "doc_id long, start long, end long, mark binary, bands array<long>"), "paragraphs")
    place = F.struct("doc_id", "start", "end")
    heads = stage(found.groupBy("mark").agg(F.min(place).alias("head"), F.first("bands").alias("bands")), "heads")
    equal = found.select("mark", place.alias("a")).join(heads.select("mark", F.col("head").alias("b")).hint("merge"), "mark")
    equal = equal.filter("a <> b").select("a", "b")

    signed = heads.select(F.explode("bands").alias("signature"), F.col("head.doc_id").alias("node"))
    pairs = stage(together(signed), "pairs")
    needed = pairs.select(F.col("center").alias("doc_id")).unionByName(pairs.select(F.col("member").alias("doc_id"))).distinct()
    contents = rows.join(needed.hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text").distinct()
    contents = stage(contents, "contents").withColumn("weight", F.expr("octet_length(text) div 6"))
    kind = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    named = lambda place: dict(zip(("doc_id", "start", "end"), place, strict=True))

    def compare(batches):
        for _, (names, left, (texts,)) in tasks_of(batches, "text"):
            links = _compare(names, left, texts, least_words, num, den)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([named(x) for x, _ in links], kind),
                                                  pa.array([named(y) for _, y in links], kind)], ["a", "b"])

    shape = "struct<doc_id: long, start: long, end: long>"
    near = blocks(groups_of(pairs), contents).mapInArrow(compare, f"a {shape}, b {shape}")
    return components(near.unionByName(equal))


def _shared_anchors(rows: DataFrame) -> DataFrame:
    """``doc_id, anchors``: places (in words) of the anchors whose next words another document seems to have.

    Rows are sorted into ranges of (signature, doc_id); signatures at the
    borders of an Arrow batch count as shared, which the hashes of whole runs
    settle afterwards.
    """

    def sign(batches):
        for batch in batches:
            for low, words in runs_of(batch.column("text")):
                at, hashes = anchors(words)
                text = words.text[at].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), batch.column("doc_id").slice(low, words.rows).take(pa.array(text)),
                     pa.array((at - _starts(words)[text]).astype(np.int32))], ["signature", "doc_id", "at"])

    signed = rows.mapInArrow(sign, "signature long, doc_id long, at int")
    signed = signed.repartitionByRange(width(rows.sparkSession), "signature", "doc_id").sortWithinPartitions("signature", "doc_id")

    def shared(batches):
        for batch in batches:
            sign, node = batch.column("signature").to_numpy(), batch.column("doc_id").to_numpy()
            if not len(sign):
                continue
            first = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
            size = np.diff(np.append(first, len(sign)))
            several = np.repeat(node[first] != node[first + size - 1], size)
            keep = pa.array(several | (sign == sign[0]) | (sign == sign[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(keep), batch.column("at").filter(keep)], ["doc_id", "at"])

    return signed.mapInArrow(shared, "doc_id long, at int").groupBy("doc_id").agg(F.collect_list("at").alias("anchors"))


def repeated_runs(rows: DataFrame) -> DataFrame:
    """``doc_id, start, end, keeper_id`` of the runs of 50 words that a document of smaller id has."""
    around = rows.join(stage(_shared_anchors(rows), "anchors").hint("merge"), "doc_id")

    def hashes(batches):
        for batch in batches:
            for low, words in runs_of(batch.column("text")):
                shingles, begins = _whole(words)
                starts, points = _starts(words), _code_points(words.data)
                lists = batch.column("anchors").slice(low, words.rows).to_pylist()
                places = [np.array(x, np.int64) + starts[i] for i, x in enumerate(lists)]
                wanted = np.zeros(len(words.start), bool)
                for i, at in enumerate(places):
                    for back in range(WINDOW):
                        p = at - back
                        wanted[p[(p >= starts[i]) & (p < starts[i + 1])]] = True
                at = np.flatnonzero(wanted)
                at = at[at + RUN <= len(words.start)]
                at = at[(words.text[at] == words.text[at + RUN - 1]) & begins[at + RUN - SHINGLE]]
                text = words.text[at].astype(np.int64)
                base = points[words.offsets[:-1]][text]
                # two hashes of the run, 96 bits together
                check = mix(sum(mix(shingles[at + j] ^ _ODD[j + 1]) * _ODD[j] for j in range(0, RUN, SHINGLE)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_stretch(shingles, at, RUN).view(np.int64)), pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                     batch.column("doc_id").slice(low, words.rows).take(pa.array(text)),
                     pa.array(points[words.start[at]] - base, pa.int64()), pa.array(points[words.end[at + RUN - 1]] - base, pa.int64())],
                    ["run", "check", "doc_id", "start", "end"])

    order = ("run", "check", "doc_id")
    runs = around.mapInArrow(hashes, "run long, check int, doc_id long, start long, end long")
    runs = runs.repartitionByRange(width(rows.sparkSession), *order).sortWithinPartitions(*order)

    def keep(batches):
        opened, name, keeper = None, None, None  # first run of the range; last run and its smallest id
        for batch in batches:
            run, check, node = (batch.column(c).to_numpy() for c in order)
            if not len(run):
                continue
            opened = (run[0], check[0]) if opened is None else opened
            new = np.concatenate([[(run[0], check[0]) != name], (run[1:] != run[:-1]) | (check[1:] != check[:-1])])
            at = np.maximum.accumulate(np.where(new, np.arange(len(run)), -1))
            low = np.where(at >= 0, node[at], node[0] if keeper is None else keeper)
            # the first run of a range may have begun before it, and keeps its name
            border = (run == opened[0]) & (check == opened[1])
            out = border | (low < node)
            mask = ~border[out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(run[out], mask=mask), pa.array(check[out], mask=mask),
                 *[batch.column(c).filter(pa.array(out)) for c in ("doc_id", "start", "end")], pa.array(low[out])],
                ["run", "check", "doc_id", "start", "end", "keeper_id"])
            name, keeper = (run[-1], check[-1]), low[-1]
        if name is not None:  # the last run may go on after the range: its smallest id, without a place
            none = pa.array([None], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([name[0]]), pa.array([name[1]]), none, none, none, pa.array([keeper])],
                                             ["run", "check", "doc_id", "start", "end", "keeper_id"])

    found = stage(runs.mapInArrow(keep, "run long, check int, doc_id long, start long, end long, keeper_id long"), "runs")
    # the first and the last run of each range: at most two rows for each shuffle partition
    lowest = found.filter("run is not null").groupBy("run", "check").agg(F.min("keeper_id").alias("low")).collect()
    known = rows.sparkSession.sparkContext.broadcast({(r["run"], r["check"]): r["low"] for r in lowest})
    columns = ["doc_id", "start", "end", "keeper_id"]

    def settle(batches):
        for batch in batches:
            node, start, end, keeper = (batch.column(c).to_numpy() for c in columns)
            named = batch.column("run").is_valid().to_numpy(zero_copy_only=False)
            if named.any():
                keeper = keeper.copy()
                run, check = (batch.column(c).fill_null(0).to_numpy() for c in ("run", "check"))
                for r, c in set(zip(run[named].tolist(), check[named].tolist(), strict=True)):
                    keeper[named & (run == r) & (check == c)] = known.value[r, c]
            gone = keeper < node
            yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (node, start, end, keeper)], columns)

    gone = found.filter("doc_id is not null").mapInArrow(settle, "doc_id long, start long, end long, keeper_id long")
    spans = gone.repartition(width(rows.sparkSession), "doc_id").sortWithinPartitions("doc_id", "start", "end", "keeper_id")

    def merge(batches):
        held = None
        for batch in batches:
            node, start, end, keeper = (batch.column(c).to_numpy() for c in columns)
            if held is not None:
                node, start, end, keeper = (np.concatenate([[h], x]) for h, x in zip(held, (node, start, end, keeper), strict=True))
            if not len(node):
                continue
            opens = np.concatenate([[True], (node[1:] != node[:-1]) | (keeper[1:] != keeper[:-1]) | (start[1:] > end[:-1])])
            first = np.flatnonzero(opens)
            last = np.append(first[1:], len(node)) - 1
            furthest = np.maximum.reduceat(end, first)
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in (node[first], start[first], furthest, keeper[first])], columns)
            held = node[last[-1]], start[first[-1]], furthest[-1], keeper[last[-1]]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held], columns)

    return spans.mapInArrow(merge, "doc_id long, start long, end long, keeper_id long")


def repeated_passages(docs: DataFrame, least_words: int = RUN, num: int = 4, den: int = 5, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """``doc_id, start, end, keeper_id``: spans of code points of ``docs`` that repeat what a smaller id keeps.

    A paragraph (a line, or lines between blank lines) of at least ``least_words``
    words goes when its 5-word shingles have a Jaccard similarity of ``num / den`` or more with a
    paragraph of another document, and so on through links; the first
    paragraph of each component by (id, place) stays.  A run of 50 words that
    another document has word for word (A-Z as a-z, any white space) goes
    unless the document has the smallest id.  Spans may overlap.  Repeats
    inside one document, shorter texts, and null or empty texts give nothing;
    rows without id take no part; rows that share an id are one document.
    Candidates by exact windows miss no run; MinHash bands find 99.5 percent of
    paragraph pairs at similarity 0.8, more above.  Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(
        "doc_id is not null and text is not null")
    spans = similar_paragraphs(rows, least_words, num, den).unionByName(repeated_runs(rows))
    return spans.groupBy("doc_id", "start", "end").agg(F.min("keeper_id").alias("keeper_id"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` less spans of code points; each cut leaves one space or line break between what it parts."""
    kept, at = [], 0
    for start, end in sorted(spans):
        if end <= at:
            continue
        kept.append(text[at:max(start, at)])
        at = end
    kept.append(text[at:])
    out = kept[0]
    for part in kept[1:]:
        if not part.strip() or not out.strip():
            out = (out + part).strip() if not part.strip() else part.lstrip()
            continue
        gap = "\n" if out[len(out.rstrip()):].count("\n") or part[:len(part) - len(part.lstrip())].count("\n") else " "
        out = out.rstrip() + gap + part.lstrip()
    return out


def remove(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the spans cut from their texts; documents of which nothing is left go, others are kept.

    ``n_chars`` is set anew where a text was cut, if there is such a column.
    """
    cuts = spans.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"))  # no column meets another's name
    joined = rows.join(cuts.hint("merge"), F.col("key") == F.col("id"), "left").select("row", "cuts")
    at = docs.columns.index(text)

    def cut(batches):  # one pass of one worker; only texts with cuts become Python strings
        for batch in batches:
            row, lists = batch.column(0), batch.column(1)
            parts = row.flatten()
            changed = pc.and_(parts[at].is_valid(), lists.is_valid())
            new = [without(parts[at][i].as_py(), [(x["start"], x["end"]) for x in lists[i].as_py()])
                   for i in np.flatnonzero(changed.to_numpy(zero_copy_only=False)).tolist()]
            if new:
                parts[at] = pc.replace_with_mask(parts[at], changed, pa.array(new, parts[at].type))
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(parts, fields=list(row.type)), changed],
                                             ["row", "changed"])

    done = joined.mapInArrow(cut, StructType([joined.schema["row"], StructField("changed", BooleanType())]))
    done = done.filter(~F.col("changed") | (F.length(F.trim(F.col("row")[text])) > 0))

    def column(name):
        if name == "n_chars":
            size = F.char_length(F.col("row")[text]).cast(docs.schema[name].dataType)
            return F.when(F.col("changed"), size).otherwise(F.col("row")[name]).alias(name)
        return F.col("row")[name].alias(name)

    return done.select(*map(column, docs.columns))
