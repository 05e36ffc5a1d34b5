"""License labels against the check SQL and on odd inputs."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.llm import licenses
from quarry.llm.queries import SQL
from tests.oracle import connect, rows_of

MIT = licenses.TEMPLATES[1].text
TEXTS = [None, "", " .,; ", "a", "mit license", "MIT-License mit license MIT", "the Mit   LICENSE apache license, Apache License",
         "license mit", "GNU General Public\nLicense, Version 3", "mitlicense mit licenses", "x " * 20_000 + "mit license",
         "é mit license ñandú İstanbul MIT LICENSE", MIT, "notice:\n" + MIT.replace("free of charge", "free of charge to you"),
         "a " + MIT.split(",")[0], licenses.TEMPLATES[4].text + " and " + licenses.TEMPLATES[6].text,
         "under cc by nc 4 0 and licensed under CC BY-NC 4.0.", "licensed " * 50 + "apache license version 2 0",
         "Licensed under CC BY-SA 4.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "y", 8), (None, "mit license", "x", 1), (None, None, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, row int").repartition(3)


def test_against_sql(spark, docs, tmp_path):
    path = str(tmp_path / "documents.parquet")
    pq.write_table(docs.toArrow(), path)
    con = connect(str(tmp_path))
    cur = con.execute(SQL["op12_licenses"])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    out = licenses.scan(docs).drop("notices")
    assert rows_of(out.columns, out.collect()) == want


def test_labels(docs):
    got = {r.doc_id: r for r in licenses.scan(docs.filter("doc_id is not null")).collect()}
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].base_labels) == (2, 0, 2, "mit")
    assert got[6].base_labels == "apache,mit" and got[6].n_words == 7
    assert got[8].base_labels == "gpl" and got[8].labels == "gpl,gpl-3.0"
    assert got[7].labels == got[9].labels == got[18].labels == ""
    assert (got[10].first_word, got[10].n_words) == (20_000, 20_002)
    assert got[12].labels == "mit" and got[12].score == 1.0 and got[12].base_labels == ""
    assert got[13].labels == "mit" and 0.6 <= got[13].score < 1  # words before the change stand in place
    assert got[14].labels == ""  # a mandatory phrase is missing
    assert got[15].labels == "bsd,gpl" and [n.label for n in got[15].notices] == ["bsd", "gpl"]
    assert got[16].labels == "cc-by-nc-4.0" and got[16].notices[0].word == 0
    assert got[19].labels == "mpl-2.0"
    for i in (0, 1, 2):
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].labels, got[i].score) == (0, 0, None, "", 0.0)


def test_empty_table_and_no_templates(docs):
    assert licenses.scan(docs.limit(0)).collect() == []
    bare = licenses.scan(docs, templates=()).filter(F.col("doc_id") == 5).collect()
    assert [r.labels for r in bare] == ["mit", "mit"]


def test_rarity_follows_the_corpus(spark, docs):
    """A word of every document is no rare word of a template."""
    filler = docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" released")).alias("text"))
    words = {w for w, t, _, _ in licenses.rare_word_index(filler, licenses.TEMPLATES) if t == 0}
    assert "released" not in words and len(words) == 3
