"""Alignment of two tokenizers against a plain version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import alignment
from quarry.llm.queries import table
from quarry.llm.tokens import vocabulary_file

SF = "/root/testdata/sf0.001"
PATH_A, PATH_B = vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model")


def byte_level():
    """What each character of a byte-level entry stands for."""
    plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
    rest = [c for c in range(256) if c not in plain]
    return {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(rest)}


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(PATH_A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
        self.of = byte_level()

    def spans(self, pieces):
        at, out = 0, []
        for p in pieces:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    def tokens(self, text):
        if not text:
            return [], [], [], []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        bytes_a = [bytes(self.of[c] for c in self.a.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                   for i in b for p in [self.b.id_to_piece(i)]]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return [], [], [], []
        return a, b, self.spans(bytes_a), self.spans(bytes_b)


def plain_rows(texts):
    plain, per = Plain(), []
    total = Counter()
    for text in texts:
        a, b, sa, sb = plain.tokens(text)
        links, start = Counter(), 0
        for i, (x0, x1) in enumerate(sa):
            while start < len(sb) and sb[start][1] <= x0:
                start += 1
            j = start
            while j < len(sb) and sb[j][0] < x1:
                links[a[i], b[j]] += 1
                j += 1
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for e in ends:
            groups.append(",".join(str(t) for t, (p, q) in zip(a, sa) if low <= p < e) + "|"
                          + ",".join(str(t) for t, (p, q) in zip(b, sb) if low <= p < e))
            low = e
        per.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        total += links
    best = defaultdict(int)
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    return [(na, nb, ng, sum(links.values()), sum(n for p, n in links.items() if total[p] == best[p[1]]),
             sum(n * total[p] for p, n in links.items()), sha) for na, nb, ng, links, sha in per]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "  ", "\n", "a", "a b", " lead", "trail ", "two  spaces here", "tab\tin it", "x\ny z", "x \ny", "x\n y", "x\n\n y",
       "<s> </s> <|endoftext|> <0x41> <unk>", "hi <|endoftext|>there", "▁ under", "a▁b c", "ﬁne ① é é", "👍🏽 👍 ‍", "日本語 テキスト",
       "a\xa0b \xa0 c", "it's we'll 123 4567", "\x00 nul \x85 x", "re " * 3000 + "end", "x" * 20_000, "don't  stop\r\n now", "﻿bom", "a　b"]


def test_odd_texts(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(ODD)] + [(5, "a", "y", 8), (None, "no id", "x", 1), (None, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, row int").repartition(3)
    got = alignment.align_documents(docs)
    want = plain_rows([r[1] for r in rows])
    key = lambda r: (r[0] is None, r)
    assert sorted([(r.doc_id, *(r[c] for c in COLUMNS)) for r in got.collect()], key=lambda r: (r[0] is None, str(r))) == sorted(
        [(r[0], *w) for r, w in zip(rows, want, strict=True)], key=lambda r: (r[0] is None, str(r)))
    small = alignment.align_documents(docs, block=40)  # the counted pairs in several blocks
    assert sorted(map(str, small.collect())) == sorted(map(str, got.collect()))
    assert alignment.align_documents(docs.limit(0)).collect() == []


def test_documents(spark):
    docs = table(spark, SF, "documents")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(docs).collect()}
    assert got == dict(zip([r.doc_id for r in rows], plain_rows([r.text for r in rows]), strict=True))


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 50, 10_000])
def test_pieces_of_a_merge(piece):
    rng = np.random.default_rng(piece)
    for n in (1, 2, 40, 400):
        last = n * 3
        a, b = (np.unique(np.append(rng.integers(1, last, rng.integers(0, n)), last)) for _ in range(2))
        at_a, at_b = alignment.diagonals(a, b, piece)
        sizes = np.diff(at_a) + np.diff(at_b)
        assert (sizes[:-1] == piece).all() and sizes.sum() == len(a) + len(b)
        ends = sorted({*a.tolist(), *b.tolist()})
        want = [(int((a < e).sum()), int((b < e).sum()), e in a and e in b) for e in ends]
        assert list(zip(*(x.tolist() for x in alignment.align(a, b, piece)))) == want
