"""License notices in documents by a positional index of rare license words.

The index holds, for the rarer half of the words of each license template, the
template and the place of the word in it.  Rarity is counted over all
documents.  A file looks up its rarest license words, each place of such a word
meets the postings of the word, and postings that agree on where the template
would begin are counted together: the share of the template's rarity that
stands in place.  A template is reported when that share is high enough and all
its mandatory phrases stand in the file.

Everything is DataFrame functions.  A file's words never leave its row; only
places of rare words do, and they are grouped by (row, template, begin).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.rows import unnest
from quarry.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text


@dataclass(frozen=True)
class Template:
    """A notice, the label it stands for, and phrases that a file must hold to carry it."""

    label: str
    text: str
    phrases: tuple[str, ...]


# Opening sentences and short notices of public licenses.
TEMPLATES = (
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
             'associated documentation files (the "Software"), to deal in the Software without restriction',
             ("permission is hereby granted free of charge", "without restriction")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3",
             ("gnu general public license", "version 3")),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation",
             ("gnu general public license", "free software foundation")),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met",
             ("redistribution and use in source and binary forms",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
             "is hereby granted", ("permission to use copy modify and or distribute this software",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
             ("mozilla public license v 2 0",)),
)
# Phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
RAREST = 16  # license words that a file looks up
SHARE = 0.6  # of a template's rarity that must stand in place


def words_of(text: Column) -> Column:
    """Words of a whole text, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"))


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def rarity(n_docs: int, df: int) -> int:
    """Inverse document frequency in thousandths, above 0."""
    return 1 + math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def rare_word_index(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> list[tuple[str, int, int, int]]:
    """Postings (word, template, place, weight), rarest word first, ties by word.

    The document frequencies are counted over all ``docs``; one number for each
    template word reaches the driver.
    """
    places = [template_words(t.text) for t in templates]
    names = sorted({w for p in places for w in p})
    vocabulary = F.array(*[F.lit(w) for w in names]) if names else F.array().cast("array<string>")
    seen = docs.select(F.array_append(F.array_intersect(vocabulary, words_of(F.col(text))), F.lit("")).alias("seen"))
    found = {r["word"]: r["n"] for r in
             unnest(seen, "seen", "word", keep=[]).groupBy("word").agg(F.count("*").alias("n")).collect()}
    weight = {w: rarity(found.get("", 0), found.get(w, 0)) for w in names}
    postings = []
    for i, p in enumerate(places):
        distinct = sorted(set(p), key=lambda w: (-weight[w], w))
        rare = set(distinct[:max(3, (len(distinct) + 1) // 2)])
        postings += [(w, i, at, weight[w]) for at, w in enumerate(p) if w in rare]
    return sorted(postings, key=lambda r: (-r[3], r[0], r[1], r[2]))


def _places(norm: str, words: str, phrase: list[str]) -> Column:
    """Where the words of ``phrase`` stand one after another, from 0."""
    def here(i):
        test = F.get(F.col(words), i) == phrase[0]
        for j, w in enumerate(phrase[1:], 1):
            test = test & (F.get(F.col(words), i + j) == w)
        return test

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), here)
    return F.when(F.contains(F.col(norm), F.lit(f" {' '.join(phrase)} ")), starts).otherwise(F.array().cast("array<int>"))


def _holds(norm: str, phrases: tuple[str, ...]) -> Column:
    test = F.lit(True)
    for phrase in phrases:
        test = test & F.contains(F.col(norm), F.lit(f" {' '.join(template_words(phrase))} "))
    return test


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases=PHRASES, key: str = "doc_id",
         text: str = "text", rarest: int = RAREST, share: float = SHARE) -> DataFrame:
    """License labels of every row: key, n_words, n_base, first_word, last_word, base_labels, labels, notices, score.

    ``phrases`` are counted wherever their words stand in a row; ``labels`` adds
    those of the templates found.  ``notices`` lists (label, word, share) of the
    best place of each template found, by label and word.  ``score`` is the
    highest share among them, 0 if there are none.

    A null or empty text has no words, empty labels and score 0.  Null or
    repeated keys are rows of their own.  Columns other than key and text are
    not read.  Long texts are scanned whole.  Among equal shares the earlier
    place counts.
    """
    postings = rare_word_index(docs, templates, text)
    ranked = list(dict.fromkeys(p[0] for p in postings))
    total = [0] * len(templates)
    for _, i, _, weight in postings:
        total[i] += weight
    lookup = F.array(*[F.lit(w) for w in ranked]) if ranked else F.array().cast("array<string>")
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key), words_of(F.col(text)).alias("words"))
    split = split.select("*", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("norm"),
                         F.slice(F.array_intersect(lookup, "words"), 1, rarest).alias("rare"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
                    lambda h: F.array_contains(F.col("rare"), h["word"]))
    none = F.array().cast("array<struct<word:string,at:int>>")
    verified = F.array_compact(F.array(*[F.when(_holds("norm", t.phrases), F.lit(i)) for i, t in enumerate(templates)]).cast(
        "array<int>"))
    base = F.array(*[F.struct(_places("norm", "words", template_words(p)).alias("at"), F.lit(label).alias("label"))
                     for p, label in phrases])
    light = stage(split.select(
        "row", key, F.size("words").cast("long").alias("n_words"), base.alias("base"),
        verified.alias("verified"), F.when(F.size("rare") > 0, hits).otherwise(none).alias("hits")), "licenses")

    index = docs.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(w), F.lit(i), F.lit(at), F.lit(x)) for w, i, at, x in postings]).cast(
            "array<struct<word:string,template:int,place:int,weight:int>>")))
    totals = F.array(*[F.lit(x) for x in total]).cast("array<int>")
    label = F.array(*[F.lit(t.label) for t in templates]).cast("array<string>")
    met = unnest(light, "hits", "hit", keep=["row", "verified"]).select("row", "verified", "hit.word", "hit.at").join(
        F.broadcast(index), "word")  # a row for each place of a word in the templates
    placed = met.groupBy("row", "template", (F.col("at") - F.col("place")).alias("begin")).agg(
        F.sum("weight").alias("in_place"), F.first("verified").alias("verified"))
    best = placed.filter(F.array_contains("verified", F.col("template"))).select(
        "row", "template", "begin", F.round(F.col("in_place") / F.get(totals, F.col("template")), 6).alias("share"))
    best = best.filter(F.col("share") >= share).groupBy("row", "template").agg(
        F.max(F.struct("share", (-F.col("begin")).alias("before"))).alias("top"))
    notice = F.struct(F.get(label, F.col("template")).alias("label"), F.greatest(-F.col("top.before"), F.lit(0)).alias("word"),
                      F.col("top.share").alias("share"))
    found = best.groupBy("row").agg(F.array_sort(F.collect_list(notice)).alias("notices"),  # at most one for each template
                                    F.max("top.share").alias("score"))

    starts = F.flatten(F.transform("base", lambda b: b["at"]))
    base_labels = F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    notices = F.coalesce("notices", F.array().cast("array<struct<label:string,word:int,share:double>>"))
    out = light.select("row", key, "n_words", starts.alias("starts"), base_labels.alias("base")).join(found, "row", "left")
    return out.select(
        key, "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"), _joined(F.col("base")).alias("base_labels"),
        _joined(F.concat("base", F.transform(notices, lambda n: n["label"]))).alias("labels"),
        notices.alias("notices"), F.coalesce("score", F.lit(0.0)).alias("score"))


def scan_sql(templates: tuple[Template, ...] = TEMPLATES, phrases=PHRASES, rarest: int = RAREST, share: float = SHARE) -> str:
    """The same for DuckDB, over ``documents``, without ``notices``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    lists = lambda words: "[" + ", ".join(map(quoted, words)) + "]"
    given = ", ".join(f"({i}, {quoted(t.label)}, {lists(template_words(t.text))}, "
                      f"{lists(' ' + ' '.join(template_words(p)) + ' ' for p in t.phrases)})" for i, t in enumerate(templates))
    base = ", ".join(f"({lists(template_words(p))}, {quoted(label)})" for p, label in phrases)
    return rf"""
WITH template(t, label, words, phrases) AS (VALUES {given}),
phrase(words, label) AS (VALUES {base}),
doc AS (SELECT row_number() OVER () AS r, doc_id,
          regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
place AS (SELECT t, unnest(words) AS word, unnest(range(len(words))) AS place FROM template),
df AS (SELECT word, count(r) AS df FROM (SELECT DISTINCT word FROM place)
       LEFT JOIN (SELECT DISTINCT r, unnest(words) AS word FROM doc) USING (word) GROUP BY word),
weight AS (SELECT word, (1 + floor(1000 * ln((2.0 * n + 2) / (2 * df + 1))))::BIGINT AS weight
           FROM df, (SELECT count(*) AS n FROM doc)),
half AS (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY weight DESC, word) AS k, count(*) OVER (PARTITION BY t) AS n
         FROM (SELECT DISTINCT t, word FROM place) JOIN weight USING (word)),
posting AS (SELECT p.t, p.word, p.place, weight FROM place p JOIN half h ON h.t = p.t AND h.word = p.word
              AND (h.k <= 3 OR h.k <= (h.n + 1) // 2) JOIN weight w ON w.word = p.word),
total AS (SELECT t, sum(weight) AS total FROM posting GROUP BY t),
word_at AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS pos FROM doc),
rare AS (SELECT r, word FROM (SELECT r, word, row_number() OVER (PARTITION BY r ORDER BY weight DESC, word) AS k
           FROM (SELECT DISTINCT r, word FROM word_at) JOIN (SELECT DISTINCT word, weight FROM posting) USING (word))
         WHERE k <= {rarest}),
placed AS (SELECT r, t, pos - place AS beg, sum(weight) AS w FROM word_at JOIN rare USING (r, word) JOIN posting USING (word)
           GROUP BY ALL),
found AS (SELECT r, t, max(round(w / total, 6)) AS share FROM placed JOIN total USING (t) JOIN template USING (t) JOIN doc USING (r)
          WHERE round(w / total, 6) >= {share}
            AND len(list_filter(phrases, lambda p: NOT contains(' ' || array_to_string(doc.words, ' ') || ' ', p))) = 0
          GROUP BY ALL),
start AS (SELECT r, label, i FROM (
            SELECT r, p.label, p.words AS pw, d.words AS dw, unnest(range(len(d.words) - len(p.words) + 1)) AS i
            FROM doc d JOIN phrase p ON list_contains(d.words, p.words[1]))
          WHERE dw[i + 1:i + len(pw)] = pw),
named AS (SELECT r, label FROM start UNION SELECT r, label FROM found JOIN template USING (t))
SELECT doc_id, len(words)::BIGINT AS n_words,
  coalesce((SELECT count(*) FROM start s WHERE s.r = d.r), 0)::BIGINT AS n_base,
  (SELECT min(i) FROM start s WHERE s.r = d.r)::BIGINT AS first_word,
  (SELECT max(i) FROM start s WHERE s.r = d.r)::BIGINT AS last_word,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM start s WHERE s.r = d.r), '') AS base_labels,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM named s WHERE s.r = d.r), '') AS labels,
  coalesce((SELECT max(share) FROM found f WHERE f.r = d.r), 0)::DOUBLE AS score
FROM doc d"""
