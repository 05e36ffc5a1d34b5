"""Quality scores of documents by histogram gradient-boosted trees over statistics of their texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage
from quarry.llm.words import Words, runs_of

KINDS = ("upper", "lower", "digit", "space", "newline", "stop", "comma", "mark", "bar", "high", "other")
_KIND = np.full(256, KINDS.index("other"), np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 0, 1, 2
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 3, 4
_KIND[[ord(".")]], _KIND[[ord(","), ord(";"), ord(":")]] = 5, 6
_KIND[[ord(c) for c in "!?#$%&*@^~+=<>_\\/"]] = 7
_KIND[[ord("|"), ord("{"), ord("}"), ord("["), ord("]")]] = 8
_KIND[128:] = 9
STATISTICS = (
    "log_bytes", "log_words", *(f"share_{k}" for k in KINDS), "word_bytes", "word_bytes_sd", "longest_word",
    "distinct_words", "repeated_next", "repeated_second", "top_word", "capital_words", "upper_words", "marked_words",
    "lines", "line_words", "distinct_lines", "copied_line_bytes", "short_lines", "words_in_sentence",
    "distinct_pairs", "one_byte_words",
)


def statistics(words: Words, raw: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; an empty text has zeros."""
    rows, at = words.rows, words.offsets
    n_bytes = np.diff(at).astype(np.float64)
    n_words = words.count.astype(np.float64)
    per_byte = lambda x: x / np.maximum(n_bytes, 1)
    per_word = lambda x: x / np.maximum(n_words, 1)
    owner = np.repeat(np.arange(rows), np.diff(at))
    kinds = np.bincount(owner * len(KINDS) + _KIND[raw], minlength=rows * len(KINDS)).reshape(rows, -1)
    text, size = words.text, (words.end - words.start).astype(np.float64)
    total = lambda weight: np.bincount(text, weight, rows)
    longest = np.zeros(rows)
    np.maximum.at(longest, text, size)
    mean = per_word(total(size))
    spread = np.sqrt(np.maximum(per_word(total(size * size)) - mean * mean, 0))

    def next_alike(gap: int) -> np.ndarray:
        alike = (words.hash[gap:] == words.hash[:-gap]) & (text[gap:] == text[:-gap]) if len(text) > gap else np.zeros(0, bool)
        return per_word(np.bincount(text[gap:][alike], minlength=rows) if len(alike) else np.zeros(rows))

    opening, closing = raw[words.start], raw[words.end - 1]
    capital = (opening >= 65) & (opening < 91)
    second = raw[np.minimum(words.start + 1, words.end - 1)]
    upper = capital & (second >= 65) & (second < 91)
    marked = np.isin(_KIND[closing], (7, 8))

    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([at[:-1][n_bytes > 0], breaks[breaks + 1 < len(raw)] + 1])) if len(raw) else breaks
    ends = np.append(starts[1:], len(raw)) if len(starts) else starts
    line_text = np.searchsorted(at, starts, "right") - 1
    ends = np.where((ends > starts) & (raw[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(starts) else ends
    line_hash = words.ranges(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    line_size = (ends - starts).astype(np.float64)
    n_lines = np.bincount(line_text, minlength=rows).astype(np.float64)
    short = np.bincount(line_text, line_size < 30, rows)

    top, distinct, pairs, unlike, copied = (np.zeros(rows) for _ in range(5))
    word_at = np.searchsorted(text, np.arange(rows + 1))
    line_at = np.searchsorted(line_text, np.arange(rows + 1))
    for i in range(rows):
        h = words.hash[word_at[i]:word_at[i + 1]]
        if len(h):
            _, times = np.unique(h, return_counts=True)
            distinct[i], top[i] = len(times), times.max()
            pairs[i] = len(np.unique(h[1:] * np.uint64(3) + h[:-1])) if len(h) > 1 else 1
        a, b = line_at[i], line_at[i + 1]
        if b > a:
            _, first = np.unique(line_hash[a:b], return_index=True)
            unlike[i] = len(first)
            copied[i] = line_size[a:b].sum() - line_size[a:b][first].sum()
    stops = kinds[:, KINDS.index("stop")]
    columns = [
        np.log1p(n_bytes), np.log1p(n_words), *per_byte(kinds.T.astype(np.float64)), mean, spread, np.log1p(longest),
        per_word(distinct), next_alike(1), next_alike(2), per_word(top), per_word(total(capital)), per_word(total(upper)),
        per_word(total(marked)), np.log1p(n_lines), n_words / np.maximum(n_lines, 1), unlike / np.maximum(n_lines, 1),
        per_byte(copied), short / np.maximum(n_lines, 1), n_words / np.maximum(stops, 1),
        pairs / np.maximum(n_words - 1, 1), per_word(total(size == 1)),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Forest:
    """Trees as arrays: node i of all trees splits on ``feature`` at ``threshold``; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics; all trees step down together."""
        out = np.full(len(x), self.base)
        for low in range(0, len(x), 2048):
            part = x[low:low + 2048]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[low:low + 2048] += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64,
        least: float = 3.0, damping: float = 1.0) -> Forest:
    """Boosted trees for labels 0/1 on the logistic loss, level by level from histograms of binned values.

    With one label only (or no rows) the forest is the constant share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    parts: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    margin = np.full(len(y), np.log(share / (1 - share)))
    features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)] if len(y) else []
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1) if len(y) else x
    at = np.arange(features) * bins

    def node(**values) -> int:
        for k, v in values.items():
            parts[k].append(v)
        return len(parts["value"]) - 1

    for _ in range(trees if len(np.unique(y)) == 2 else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        roots.append(node(feature=0, threshold=np.inf, left=-1, right=-1, value=0.0))
        open_nodes = [(roots[-1], np.arange(len(y)))]
        for level in range(depth + 1):
            following = []
            for i, rows in open_nodes:
                g, h = grad[rows].sum(), hess[rows].sum()
                parts["value"][i], parts["left"][i], parts["right"][i] = rate * g / (h + damping), i, i
                margin_rows = rows
                split = None
                if level < depth and len(rows) >= 2 * least:
                    flat = (binned[rows] + at).ravel()
                    gl = np.cumsum(np.bincount(flat, np.repeat(grad[rows], features), features * bins).reshape(features, bins), 1)
                    hl = np.cumsum(np.bincount(flat, np.repeat(hess[rows], features), features * bins).reshape(features, bins), 1)
                    nl = np.cumsum(np.bincount(flat, minlength=features * bins).reshape(features, bins), 1)
                    gain = gl**2 / (hl + damping) + (g - gl) ** 2 / (h - hl + damping) - g * g / (h + damping)
                    gain[(nl < least) | (len(rows) - nl < least)] = -np.inf
                    best = int(np.argmax(gain))
                    if gain.flat[best] > 1e-6:
                        split = divmod(best, bins)
                if split is None:
                    margin[margin_rows] += parts["value"][i]
                    continue
                f, b = split
                goes = binned[rows, f] <= b
                parts["feature"][i], parts["threshold"][i] = f, cuts[f][b]
                for side, mine in (("left", rows[goes]), ("right", rows[~goes])):
                    parts[side][i] = node(feature=0, threshold=np.inf, left=-1, right=-1, value=0.0)
                    following.append((parts[side][i], mine))
                parts["value"][i] = 0.0
            open_nodes = following
    return Forest(np.array(parts["feature"], np.int64), np.array(parts["threshold"]), np.array(parts["left"], np.int64),
                  np.array(parts["right"], np.int64), np.array(parts["value"]), np.array(roots, np.int64), depth,
                  float(np.log(share / (1 - share))))


def held_out(key: Column) -> Column:
    """Rows kept from learning: checksum of the key as text modulo 5 is 0 (a null key counts as the text "")."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns of ``docs`` and the statistics of the whole text, as an array; null counts as empty."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def work(batches):
        for batch in batches:
            column = batch.column("_text")
            for low, words in runs_of(column, lower=False):
                x = statistics(words, words.data)
                part = batch.slice(low, len(x))
                flat = pa.array(x.ravel(), pa.float32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [lists], [*keep, "statistics"])

    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    shape = StructType([rows.schema[c] for c in keep] + [StructField("statistics", ArrayType(FloatType()))])
    return rows.mapInArrow(work, shape)


def labelled(keys: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id",
             most_rows: int = 20_000) -> DataFrame:
    """(_key, _label, _order) of the learning keys that occur in ``keys``, about ``most_rows`` of them or all.

    Only labels 0 and 1 count, and none of held-out keys; a key labelled twice
    counts with its larger label.  The keys are counted first, and a bound on
    their hash leaves a fifth and 1000 more than ``most_rows``, so the number
    that any later step sees does not grow with the tables.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    met = keys.select(F.col(key).alias("_key")).distinct().join(known, "_key").withColumn("_order", F.xxhash64("_key"))
    share = min(1.0, (1.2 * most_rows + 1000) / max(1, met.count()))
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    return met.filter(F.col("_order") <= bound)


def train(rows: DataFrame, chosen: DataFrame, key: str = "doc_id", most_rows: int = 20_000, **options) -> Forest:
    """Fit on the at most ``most_rows`` keys of smallest hash among the ``chosen`` ones.

    ``rows`` has ``key`` and ``statistics``; a repeated key counts with the
    smallest of its rows' statistics.  What is collected is bounded by :func:`labelled`.
    """
    met = rows.select(F.col(key).alias("_key"), "statistics").join(F.broadcast(chosen), "_key")
    pulled = met.groupBy("_key", "_label", "_order").agg(F.min("statistics").alias("statistics")).toPandas()
    pulled = pulled.sort_values(["_order", "_key"]).head(most_rows).sort_values("_key")
    x = np.array(pulled["statistics"].tolist(), np.float32).reshape(-1, len(STATISTICS))
    return fit(x, pulled["_label"].to_numpy(np.float64), **options)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, threshold: float = 0.3,
             key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``keep`` columns (the key), ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    Statistics of every whole text are staged once; the forest is fitted on a
    bounded sample of labelled rows, never on held-out ones; each task scores
    its rows.  Null and empty texts have the score of zero statistics.  Rows
    with a null or repeated key are scored like any other.  Without labelled
    rows all scores are 0.5.
    """
    keep = list(dict.fromkeys([key, *(keep or [])]))
    rows = stage(with_statistics(docs, keep, text), "statistics")
    forest = train(rows, labelled(rows, labels, key=key), key, **options)

    @F.pandas_udf("double")
    def score(values):
        import pandas as pd

        x = np.array(values.tolist(), np.float32).reshape(-1, len(STATISTICS))
        return pd.Series(forest.score(x))

    return rows.select(*keep, held_out(F.col(key)).alias("held_out"), score("statistics").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text",
             **options) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns.

    To fit the forest, statistics are made of the learning rows alone; those of
    all rows are made where the rows are filtered, so no text is shuffled or
    written.
    """
    chosen = stage(labelled(docs, labels, key=key), "chosen")
    learning = docs.select(key, text).join(F.broadcast(chosen.select(F.col("_key").alias(key))), key, "left_semi")
    forest = train(with_statistics(learning, [key], text), chosen, key, **options)
    at = docs.columns.index(text)

    def work(batches):
        for batch in batches:
            column = batch.column(at)
            keep = [forest.score(statistics(words, words.data)) >= threshold for _, words in runs_of(column, lower=False)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(work, docs.schema)
