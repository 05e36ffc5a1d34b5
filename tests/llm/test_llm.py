"""Operators of the subpackage llm against brute force, with odd inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, fingerprints, html, mixing, packing, partenum, passages, pfor, quality, sharding
from quarry.llm.common import scratch
from quarry.llm.queries import QUERIES, SQL
from quarry.llm.tokens import encoder, vocabulary_file
from tests.oracle import connect, rows_of

SF = "/root/testdata/sf0.001"
VOCABULARY = vocabulary_file("byte_bpe_50k.json")
WORDS = [f"w{i}" for i in range(400)]
SHAPE = "doc_id long, text string, source string, slot string, shard string, component_id string, _part string"


def passage(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows, and columns called like those that operators add."""
    texts = [None, "", " ", "\n\n", "a", "A  b", "tab\tand nbsp", "👍 é\n👍", "x" * 30_000, passage(9_000, 1),
             passage(200, 2), passage(200, 2), "one two three", "One two THREE", passage(70, 3) + "\n" + passage(60, 4),
             passage(20, 5) + " " + passage(60, 4) + " " + passage(30, 6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id here"), (None, None), (10, texts[10]), (4, "a")]
    return spark.createDataFrame([(i, t, "s" if i == 3 else None, "x", "x", "x", "x") for i, t in rows], SHAPE).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def plain(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def ids_of(text, end):
    return np.append(encoder(VOCABULARY).whole([text])[0], end).astype("<u4")


def test_blocks_of_ids_round_trip():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 50257, 1000), [], [5], [7] * 300, rng.integers(0, 2**32, 700), [0, 2**32 - 1] * 5 + [1] * 300):
        ids = np.array(ids, np.uint32)
        data, start = pfor.pack_blocks(ids)
        assert np.array_equal(pfor.unpack_blocks(data, start, len(ids)), ids)


def test_token_files(spark, odd, empty):
    path = scratch(spark, "test")
    pfor.write_tokens(odd, path, VOCABULARY, segment_tokens=500)
    got = pfor.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    want = sorted(plain(odd), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1].encode()), zlib.crc32(r[1].encode())))
    at = 0
    for g, (i, t) in zip(got, want, strict=True):
        ids = ids_of(t, 2)
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32, g.ids) == (i, at, len(ids), zlib.crc32(ids), ids.tolist())
        at += len(ids)
    path = scratch(spark, "test")
    pfor.write_tokens(empty, path, VOCABULARY)
    assert pfor.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard_classes(spark, odd, empty, k, num, den):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select(
        (F.col("doc_id") + 100).alias("doc_id"), "text").collect()] + [r for r in plain(odd) if r[0] is not None]
    base = passage(120, 9).split()
    for i in range(30):  # a chain of near copies
        base[i] = f"changed{i}"
        docs.append((1000 + i, " ".join(base)))
    sets = defaultdict(list)
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i].append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for x, (i, a) in enumerate(flat):
        for j, b in flat[x + 1:]:
            if den * len(a & b) >= num * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    got = partenum.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), k, num, den).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}
    assert partenum.jaccard_classes(empty, k, num, den).count() == 0
    assert partenum.one_of_each(odd).columns == odd.columns


def test_signatures_miss_no_similar_pair():
    rng = np.random.default_rng(0)
    for num, den in ((9, 10), (4, 5)):
        for _ in range(300):
            a = np.unique(rng.integers(0, 2**63, int(rng.choice([1, 3, 5, 9, 10, 15, 30, 80, 300]))).astype(np.uint64))
            most = len(a) * (den - num) // num
            out = int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[out:], rng.integers(0, 2**63, most - out).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(b) and den * common >= num * (len(a) + len(b) - common):
                both = np.concatenate([a, b])
                found, at = partenum.signatures(both, np.array([0, len(a), len(both)]), num, den)
                assert len(np.intersect1d(found[:at[1]], found[at[1]:]))
                raw = partenum.sketches(both, np.array([0, len(a), len(both)]))
                assert partenum.may_link(raw, np.array([len(a), len(b)]), 2, num, den).all()


def test_quality(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    scored = quality.classify(odd, labels, keep=["slot"]).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    assert quality.accepted(odd, labels.limit(0)).count() == odd.count()


def test_flat_trees_are_walked_like_nodes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    forest = quality.fit(x, (x[:, 1] + x[:, 3] > 0).astype(float), trees=10)

    def walk(row, node):
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        return forest.value[node]

    want = [1 / (1 + np.exp(-(forest.base + sum(walk(r, n) for n in forest.roots)))) for r in x]
    assert np.allclose(forest.score(x), want)


def test_mixing(odd, empty):
    rows = mixing.mix(odd, {"s": 3, "other": 2}, block_rows=2).collect()
    assert sorted(r.position for r in rows) == list(range(odd.count()))
    assert all(r.release <= r["slot"] < r.due for r in rows)
    assert mixing.mix(empty, {"s": 3}).count() == 0


def test_period_keeps_every_share_within_a_block(spark):
    shares = [20, 7, 1, 5]
    rows = mixing.period(spark, shares).orderBy("at").collect()
    seen = [0] * len(shares)
    for t, r in enumerate(rows):
        assert (r.at, r.k, list(r.before)) == (t, seen[r.queue], seen)
        seen[r.queue] += 1
        assert all(abs(s * sum(shares) - a * (t + 1)) < sum(shares) for s, a in zip(seen, shares, strict=True))


def test_byte_shards(odd, empty):
    rows = sharding.byte_shards(odd, 4).collect()
    want = sorted((i is not None, i or 0, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in plain(odd))
    got = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got] == want
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.byte_shards(empty).count() == 0


def test_extraction(spark):
    body = "<nav><a>menu</a></nav><div class='ad'>buy</div>{}<aside>side</aside><footer>foot &copy;</footer>"
    bare = "<html><head><title>t</title></head><body><p>Site of things</p><p>{}</p><p>All rights</p></body>"
    pages = [(1, "http://h/a/1", body.format("<article><h1>T &amp; u</h1><p>a\n b&nbsp;c<i>d</i><br>e<p>f"
                                             "<div class='comments'>no</div></article>")),
             (2, "http://g/x/1", bare.format("first text")), (3, "http://g/x/2", bare.format("second text")),
             (4, "http://alone/", bare.format("lonely")), (5, None, None), (6, "http://g/x/2", ""),
             (7, "http://k/1", "<p>same</p>"), (8, "http://k/2", "<p>same</p>"), (None, "u", "<script>var a='</p>'</script>x")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, lines string")
    got = {r.page_id: r.text for r in html.extract(df.repartition(3)).collect()}
    assert got == {1: "T & u a b cd e f", 2: "first text", 3: "second text", 4: "Site of things lonely All rights", 5: "",
                   6: "", 7: "same", 8: "same", None: "x"}
    assert html.extract(df.limit(0)).count() == 0


def test_extraction_open_page_among_articles(spark):
    page = "<p>Site of things</p>{}<p>All rights</p>"
    pages = [(1, "http://h/a/1", page.format("<p>open text</p><p>told</p>")),
             (2, "http://h/a/2", page.format("<article><p>told</p><p>shared</p></article>")),
             (3, "http://h/b/3", page.format("<article><p>shared</p></article>")), (4, "http://h/a/1", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    # lines outside the articles go, lines of an article are text also where pages share them
    assert {r.page_id: r.text for r in html.extract(df).collect()} == {1: "open text told", 2: "told shared", 3: "shared", 4: ""}


def test_extraction_differences_pages_with_articles(spark):
    page = "<p>Site of things</p>{}<p>All rights</p>"
    pages = [(1, "http://h/a/1", page.format("<p>by one</p><article><p>told</p></article><p>added later</p>")),
             (2, "http://h/a/2", page.format("<p>by two</p><article><p>told</p><p>Site of things</p></article>")),
             (3, "http://alone/1", page.format("<article><p>single</p></article>")),
             (4, "http://g/1", page.format("<article><p>x</p></article>")), (5, "http://g/2", "<article><p>y</p></article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    # lines outside the articles go where the nearest page has them outside too; the article is a veto
    assert {r.page_id: r.text for r in html.extract(df.repartition(3)).collect()} == {
        1: "by one told added later", 2: "by two told Site of things", 3: "single", 4: "x", 5: "y"}



def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, 2.0]), (None, x[0].tolist()),
             (5004, [None] * 16), (5005, []), (5006, x[50].tolist()), (5050, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.search(ann.build_index(df, block_rows=400), df.filter("vec_id % 50 = 0"), block_queries=7).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r.query_id].append((r.vec_id, r.score))
    assert by.pop(5050) == [(5003, pytest.approx(0.8))] and 5000 not in by
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, found in by.items():
        score = unit @ unit[q]
        score[q] = -2
        best = set(np.argsort(-score)[:5].tolist())
        hits += len(best & {50 if v == 5006 else v for v, _ in found} | ({50} & best if q == 50 else set()))
        assert len(found) == 5 and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert hits / (5 * len(by)) >= 0.9
    assert by[50][0][0] == 5006
    assert ann.search(ann.build_index(df.limit(0)), df.limit(0)).count() == 0


def test_packing(odd, empty):
    rows = packing.pack(odd, VOCABULARY, hold_tokens=2_000).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == parts[0].window <= 2048 and at & (at - 1) == 0
    whole = {i: ids_of(t, 1) for i, t in plain(odd) if i not in (None, 4, 10)}
    for i, ids in whole.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length])
            at += r.length
        assert at == len(ids)
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_passages(spark, odd, empty):
    spans = passages.repeated_passages(odd)
    found = {(r.doc_id, r.keeper_id) for r in spans.collect()}
    assert found == {(11, 10), (15, 14)}
    left = {r.doc_id: r.text for r in passages.remove(odd, spans).collect()}
    assert left[15] == passage(20, 5) + " " + passage(30, 6) and 11 not in left
    assert left[14] == passage(70, 3) + "\n" + passage(60, 4)
    near = passage(100, 8).split()
    near[40] = "else"
    df = spark.createDataFrame([(1, "x y\n" + passage(100, 8)), (2, " ".join(near) + "\nown line"), (3, passage(45, 4)),
                                (4, passage(45, 4))], "doc_id long, text string")
    cut = {r.doc_id: r.text for r in passages.remove(df, passages.repeated_passages(df)).collect()}
    assert cut[2] == "own line" and cut[3] == cut[4] == passage(45, 4)
    assert passages.repeated_passages(empty).count() == 0


def test_paragraph_linked_past_one_of_its_own_document():
    a = np.arange(1000, dtype=np.uint64)
    first, own = a[:100], a[10:110]  # 90 / 110 in common
    x, v = np.concatenate([a[:95], a[200:205]]), a[5:105]
    sets, names = [x, first, own, v], [1, 2, 2, 3]
    similar = lambda p, q: 5 * len(np.intersect1d(p, q)) >= 4 * len(np.union1d(p, q))
    want = {(i, j) for i in range(4) for j in range(i + 1, 4) if names[i] != names[j] and similar(sets[i], sets[j])}
    assert similar(first, own) and (2, 3) in want
    found = partenum.linked(sets, 4, 4, 5, names)
    assert set(found) <= want and {i for pair in found for i in pair} == {0, 1, 2, 3}
    assert partenum.linked([first, own], 2, 4, 5, [2, 2]) == []


def test_wrapped_paragraphs(spark):
    words = passage(100, 21).split()
    near = [*words]
    near[33] = near[66] = "else"  # no run of 50 words is left
    wrap = lambda w, n: "\n".join(" ".join(w[i:i + n]) for i in range(0, len(w), n))
    texts = [(1, "head\n\n" + wrap(words, 20) + "\n\ntail"), (2, "own\n \n" + wrap(near, 15) + "\n\nend"), (3, " ".join(near))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    cut = {r.doc_id: r.text for r in passages.remove(df, passages.repeated_passages(df)).collect()}
    assert cut == {1: texts[0][1], 2: "own\nend"}


def test_runs_against_brute_force(spark):
    import random

    dice = random.Random(5)
    shared = [[f"p{n}w{dice.randrange(400)}" for _ in range(size)] for n, size in enumerate((49, 50, 51, 75, 160))]
    docs = []
    for i in range(60):
        words = []
        for _ in range(dice.randrange(1, 6)):
            words += [f"u{dice.randrange(10 ** 6)}" for _ in range(dice.randrange(0, 40))]
            part = dice.choice(shared)
            cut = dice.randrange(0, 12)
            words += part[cut:] if dice.random() < 0.5 else part
        docs.append((i, " \u00e9 ".join([" ".join(words[:30]), "  ".join(words[30:])])))
    runs, where = {}, {}
    for i, text in docs:
        ends = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        where[i] = [(tuple(text[a:b] for a, b in ends[p:p + 50]), ends[p][0], ends[p + 49][1]) for p in range(len(ends) - 49)]
        for run, *_ in where[i]:
            runs[run] = min(i, runs.get(run, i))
    want = {(i, c) for i, found in where.items() for run, a, b in found if runs[run] < i for c in range(a, b)}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = passages.repeated_runs(df).collect()
    assert want and {(r.doc_id, c) for r in found for c in range(r.start, r.end)} == want
    assert all(r.keeper_id < r.doc_id for r in found)


def test_fingerprints(odd, empty):
    rows = fingerprints.edited_fingerprints(odd).collect()
    order = sorted(plain(odd), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1].encode()), zlib.crc32(r[1].encode())))
    want = []
    for n, (i, t) in enumerate(order):
        m = len(t) // 4
        edited = t[:len(t) - m] + order[(n + 1) % len(order)][1][:m]
        sums = fingerprints.Sums.of([fingerprints.paragraphs(t), fingerprints.paragraphs(edited)]).strings()
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *sums))
    key = lambda r: tuple(str(c) for c in r)
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    a, b = (fingerprints.Sums.of([fingerprints.paragraphs(x)]).strings()[0] for x in ("One. Two.\nThree.", "Three.\nOne. Two."))
    assert a == b
    assert fingerprints.updated(a, inserted=["Four."], deleted=["Two."]) == \
        fingerprints.Sums.of([["One.", "Three.", "Four."]]).strings()[0]
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_mixing_query_matches_sql(spark):
    con = connect(SF)
    for name, sql in SQL.items():
        df = QUERIES[name](spark, SF)
        cur = con.execute(sql)
        assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} <= before and sum(r.length for r in rows) > 0
