"""Folders by owner, ids as the library gives them, pages in linear time, columns of any name."""

import re
import threading
import time
from html import unescape

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from quarry.llm import html, mixing, passages
from quarry.llm.common import Folders, free_name, stage
from quarry.llm.queries import QUERIES, TARGETS, table
from quarry.llm.tokens import encoder, vocabulary_file

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(500)]


def test_a_held_result_outlives_the_pipeline(spark):
    held = QUERIES["op5_sharding"](spark, SF)
    n = held.count()
    assert pipeline.run(spark, SF).count() > 0
    assert held.count() == n


def test_owners_delete_their_own(spark):
    one, two = Folders(), Folders()
    with one.collecting():
        a = stage(spark.range(3), "a")
        with two.collecting():
            b, c = stage(spark.range(4), "b"), stage(spark.range(5), "c")
            two.release(spark, b)
    free = stage(spark.range(6), "free")
    assert len(one.paths) == 2 and not two.paths  # what the inner owner still had went to the outer one
    one.release(spark, a)
    assert (a.count(), free.count()) == (3, 6)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        c.collect()


def test_two_threads_of_passages(spark):
    """Each thread's folders stay while the other's are deleted."""
    docs = table(spark, SF, "documents").select("doc_id", "text")
    want = sorted(map(tuple, passages.repeated_passages(docs).collect()))
    found, errors = [], []

    def run():
        try:
            found.append(sorted(map(tuple, passages.repeated_passages(docs).collect())))
        except Exception as exc:  # shown by the assertion
            errors.append(exc)

    threads = [threading.Thread(target=run) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and found == [want, want]


def test_special_tokens_in_a_text():
    path = vocabulary_file("byte_bpe_50k.json")
    import pyarrow as pa

    texts = ["hi <|endoftext|> there", "<|endoftext|>", "a b<|endoftext|>c\nd", "plain words here", "", None, "x <|endoftext|"]
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0]
    got = []
    for _, ids, counts in encoder(path).encode(pa.array(texts)):
        got += [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == want


OLD = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S)


def test_markup_as_one_pattern_finds_it():
    rng = np.random.default_rng(7)
    pieces = ["<a", "<b ", "</a", ">", '"', "'", " x=", "text ", "<!--", "-->", "<!", "<?", "<", "/", "=", "\n"]
    for _ in range(3000):
        page = "".join(rng.choice(pieces, rng.integers(1, 25)))
        markup, at, got = html._Markup(page), 0, []
        while True:
            start, past, tag, closing, attributes = markup.next(at)
            if start < 0:
                break
            got.append((start, past, tag, closing, attributes))
            at = past
        want = [(m.start(), m.end(), (m[2] or "").lower(), m[1] == "/", m[3] or "") for m in OLD.finditer(page)]
        assert got == want, page


@pytest.mark.parametrize("page", [
    "<div>" * 200_000, "<a '" * 250_000, "<a '" * 250_000 + ">", "<a \"'" * 200_000 + ">", "<script>" + "</script " * 110_000,
    "<!" * 500_000, "<" * 1_000_000, "<div></p>" * 110_000, "<div>" * 100_000 + "</section>" * 50_000 + "</div>" * 100_000, "<p a=\"" * 170_000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html.blocks(page)
    assert time.process_time() - began < 6  # a megabyte; the quadratic form took minutes


def test_lcs_against_a_plain_version():
    """Lines deleted by differencing: a longest common subsequence, by dynamic programming."""
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = ([f"l{i}" for i in rng.permutation(12)[:rng.integers(0, 12)]] for _ in range(2))
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
        shared = html.shared_lines(a, b)
        kept = [a[i] for i in sorted(shared)]
        at = iter(b)
        assert len(kept) == n[-1][-1] and all(line in at for line in kept)


def test_articles_by_a_plain_version(spark):
    """The given pages have one article each: its paragraphs, unescaped and with single spaces, are the main text."""
    rows = {r.page_id: r.text for r in html.extract(table(spark, SF, "pages")).collect()}
    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    assert set(rows) == set(pages)
    for i, page in pages.items():
        article = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
        if article:
            body = re.sub(r"<(script|style)\b.*?</\1>", " ", article[1], flags=re.S)
            plain = " ".join(unescape(re.sub(r"<[^>]+>", " ", body)).split())
            assert set(rows[i].split()) <= set(plain.split())


NAMES = ["at", "k", "before", "_id", "_base", "_cut", "_cuts", "_part", "_at", "_rank", "_round", "_total", "_first", "row", "node", "id",
         "key", "cuts", "changed", "queue", "block", "position", "release", "due", "slot", "_text", "_key", "_order", "_label"]


@pytest.fixture(scope="module")
def clashing(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(WORDS, 80)) for _ in range(6)]
    texts += [texts[0], texts[1] + " " + " ".join(rng.choice(WORDS, 60)), None, "", "short"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, shape).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES[:-1]])
def test_stages_leave_columns_alone(spark, clashing, name):
    given = {r.doc_id: r for r in clashing.collect()}
    out = dict(pipeline.STAGES)[name](spark, clashing, SF)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)
    assert all(r.source == given[r.doc_id].source for r in rows)


def test_stages_on_an_empty_table(spark, clashing):
    for _, step in pipeline.STAGES:
        assert step(spark, clashing.limit(0), SF).collect() == []


def test_mix_keeps_columns(spark, clashing):
    out = mixing.mix(clashing, TARGETS)
    added = {"queue", "block", "release", "due", "slot", "position"}
    assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in NAMES if n not in added)
    assert sorted(r.position for r in out.collect()) == list(range(clashing.count()))
    assert free_name(clashing, "node") == "_node"
