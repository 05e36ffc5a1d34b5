"""Token ids of whole columns of texts.

A text's tokens never reach across the place where a space or line break
follows a visible character, so texts are cut there, equal pieces are encoded
once by the tokenizers library, and the ids are put together again.  Texts with
any other white space, with runs of it, or with the string of a special token
are encoded as they are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm.common import slices, text_buffer

SLICE = 3_000_000  # bytes of text encoded at a time
KNOWN = 500_000  # pieces whose ids a worker keeps; others are encoded again
JOINED = 2_000  # pieces handed to the library in one call


def vocabulary_file(name: str) -> str:
    """Where the installed package of public vocabularies keeps ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and vocabulary."""
    return Encoder(path)


class Encoder:
    """Ids of texts under one byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # one id each, also in a text
        names = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(names.values()) + 1, bool)  # ids that can begin a piece
        for name, i in names.items():
            self.opens[i] = name[0] in "ĠĊ"  # how the vocabulary writes a space and a line break
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as the library gives them."""
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and where each begins."""
        ids = []
        for i in range(0, len(pieces), JOINED):
            joined = "".join(p if p[0] == "\n" else " " + p for p in pieces[i:i + JOINED])
            ids.append(np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, np.uint32))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        starts = np.flatnonzero(self.opens[flat])
        if len(starts) != len(pieces):
            raise ValueError("a piece does not begin with its white space")
        return flat, np.append(starts, len(flat))

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length) for distinct pieces; new ones are encoded and kept while there is room."""
        found = pc.index_in(words, value_set=self.known)
        missing = pc.filter(words, pc.is_null(found))
        flat, at = self._pieces(missing.to_pylist())
        place = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(missing))
        starts = np.concatenate([self.at[:-1], len(self.flat) + at[:-1]])[place]
        ends = np.concatenate([self.at[1:], len(self.flat) + at[1:]])[place]
        both = np.concatenate([self.flat, flat])
        if len(missing) and len(self.known) < KNOWN:
            self.known = pa.concat_arrays([self.known, missing])
            self.flat, self.at = both, np.append(self.at, len(self.flat) + at[1:])
        return both, starts, ends - starts

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        opened = pc.binary_join_element_wise(pa.scalar("\n", texts.type), texts, pa.scalar("", texts.type))
        lists = pc.split_pattern(pc.replace_substring(opened, "\n", " \n"), " ")
        owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        pieces = lists.values.cast(pa.string()).dictionary_encode()
        index = pieces.indices.to_numpy()
        words = pieces.dictionary
        odd = pc.or_(pc.match_substring_regex(words, r"^\n?$"),
                     pc.match_substring_regex(words, r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                                                     r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"))
        for name in self.special:
            odd = pc.or_(odd, pc.match_substring(words, name))
        odd = odd.to_numpy(zero_copy_only=False)
        first = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
        bad = odd[index]
        bad[first] = False  # the empty piece before the line break that was put in front
        whole = np.zeros(len(texts), bool)
        whole[owner[bad]] = True
        whole[pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)] = True
        keep = np.ones(len(index), bool)
        keep[first] = False
        keep[whole[owner]] = False
        index, owner = index[keep], owner[keep]
        used, index = np.unique(index, return_inverse=True)
        both, start, length = self._table(words.take(pa.array(used)))
        n = length[index]
        begin = np.cumsum(n) - n
        ids = both[np.repeat(start[index] - begin, n) + np.arange(n.sum())]
        counts = np.bincount(owner, n, len(texts)).astype(np.int64)
        # the line break in front of each text is the first id of its first piece
        at = np.cumsum(counts) - counts
        ids = np.delete(ids, at[~whole])
        counts[~whole] -= 1
        if not whole.any():
            return ids, counts
        own = iter(self.whole([t for t, w in zip(texts.to_pylist(), whole, strict=True) if w]))
        at = np.concatenate([[0], np.cumsum(counts)])
        parts = [next(own) if w else ids[at[i]:at[i + 1]] for i, w in enumerate(whole)]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode(self, texts: pa.Array):
        """Yields (first row, ids, ids of each row) for runs of rows; a null text is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets = text_buffer(texts)
        for low, high in slices(offsets, SLICE):
            ids, counts = self._slice(texts.slice(low, high - low))
            yield low, ids, counts
            del ids, counts
            pa.default_memory_pool().release_unused()

