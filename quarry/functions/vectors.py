"""Vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quarry.functions.text import normalize_text

HASH_DIM = 256
CHARS_AT_ONCE, ROWS_AT_ONCE = 1 << 17, 2048  # bytes and texts whose characters are laid out at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty, unequal or zero vectors."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    length = norm(a) * norm(b)
    return F.when(F.coalesce(usable, F.lit(False)) & (length > 0), dot(a, b) / length).otherwise(F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0), lambda s, x: s + x)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct-token arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def text_slices(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of at most ``ROWS_AT_ONCE`` rows and, but for a single longer row, ``CHARS_AT_ONCE`` bytes."""
    edges, out, low = np.concatenate([[0], np.cumsum(lengths)]), [], 0
    while low < len(lengths):
        high = int(np.searchsorted(edges, edges[low] + CHARS_AT_ONCE, "right")) - 1
        out.append((low, min(max(high, low + 1), low + ROWS_AT_ONCE, len(lengths))))
        low = out[-1][1]
    return out


def hash_vectors(texts: pa.Array) -> np.ndarray:
    """Counts of hashed adjacent characters of every text, unit length; a null is a text without characters."""
    counts = np.zeros((len(texts), HASH_DIM))
    texts = texts.fill_null("")
    chars = pc.utf8_length(texts).to_numpy().astype(np.int64)
    for low, high in text_slices(pc.binary_length(texts).to_numpy()):
        codes, edges = _low_bytes(texts.slice(low, high - low)), np.cumsum(chars[low:high])
        if not len(codes):
            continue
        key = np.repeat(np.arange(high - low) * HASH_DIM, chars[low:high])
        key[:-1] += codes[:-1] * np.uint8(31) + codes[1:]  # HASH_DIM is 2 ** 8, the sum a byte
        found = np.bincount(key, minlength=(high - low) * HASH_DIM)
        found[key[edges[chars[low:high] > 0] - 1]] -= 1  # the last character of a text has no next one
        counts[low:high] = found.reshape(-1, HASH_DIM)
    length = np.sqrt(np.einsum("ij,ij->i", counts, counts))[:, None]
    return np.divide(counts, length, out=counts, where=length > 0)


def _low_bytes(texts: pa.Array) -> np.ndarray:
    """The last 8 bits of every character's number, of all texts in a row; the texts are not null."""
    if pa.types.is_string_view(texts.type):
        texts = texts.cast(pa.string())
    wide = pa.types.is_large_string(texts.type)
    edges = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]]
    beyond = data >= 0x80
    if not beyond.any():
        return data
    # In UTF-8 they are the last six bits of a character's last two bytes: two and six of them.
    last = np.append((data[1:] & 0xC0) != 0x80, True)
    before = np.append(np.uint8(0), data[:-1])
    return np.where(beyond, ((before & 3) << 6) | (data & 0x3F), data)[last]


@F.arrow_udf(ArrayType(DoubleType()))
def embedded(texts: pa.Array) -> pa.Array:
    """:func:`hash_embedding` of texts that are normalised."""
    made = hash_vectors(texts)
    return pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * HASH_DIM, made.ravel())


def hash_embedding(c: Column) -> Column:
    """Model-free embedding: hashed adjacent-character counts, unit length."""
    return embedded(normalize_text(c))
