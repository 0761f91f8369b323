"""Licence scan by a positional index of rare words. Native: DataFrame and SQL functions only.

Each licence is a template: a run of public licence wording with its mandatory key phrases at their places. Of each phrase the word
that is rarest in the documents (highest idf) is its entry in the index. A file's occurrences of index words meet their postings;
an occurrence minus the posting's place is where the template would begin, and a template is a candidate where its phrases agree
on that place. Then the words of every key phrase are compared. The documents are read twice: for the words' document
frequencies and for the occurrences of index words, each with the few words around it; nothing else leaves a text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import once
from quillon.llm.common import release, stage
from quillon.llm.terms import ascii_lower, duck_words, split_words


@dataclass(frozen=True)
class Template:
    """A label, the wording in lower-case words and the key phrases in it, in order; base templates are one phrase and count their places."""

    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False

    def starts(self) -> list[int]:
        """Where each phrase begins in the wording, in words."""
        words, found, at = self.text.split(), [], 0
        for phrase in self.phrases:
            own = phrase.split()
            at = next(k for k in range(at, len(words)) if words[k : k + len(own)] == own)
            found.append(at)
            at += len(own)
        return found


def _phrase(label: str, text: str, base: bool = False) -> Template:
    return Template(label, text, (text,), base)


# The base phrases and their labels.
BASE = [_phrase("mit", "under the mit license", True), _phrase("apache-2", "apache license version 2", True), _phrase("cc-by-nc", "cc by nc", True)]
# Wording of public licences and of their notices, as words.
OWN = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "obtaining a copy of this software", "to deal in the software without restriction")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "with or without modification are permitted", "following conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute", "with or without fee is hereby granted")),
    Template("gpl-3", "gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "free software foundation", "version 3 of the license")),
    Template("gpl-2", "gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "free software foundation", "version 2 of the license")),
    _phrase("lgpl", "gnu lesser general public license"),
    _phrase("agpl-3", "gnu affero general public license"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("the apache license version 2 0", "may not use this file except in compliance")),
    _phrase("mpl-2", "mozilla public license v 2 0"),
    _phrase("unlicense", "this is free and unencumbered software released into the public domain"),
    _phrase("cc-by", "creative commons attribution 4 0 international"),
    _phrase("cc-by-sa", "creative commons attribution sharealike"),
    _phrase("cc-by-nc", "creative commons attribution noncommercial"),
    _phrase("all-rights-reserved", "all rights reserved"),
]
#: Words by which the phrases of one template may stand nearer or further apart than in its wording.
SLACK = 8


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for p in t.phrases for w in p.split()})


def _words(text: Column) -> Column:
    return split_words(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))))


def rarity(docs: DataFrame, text: str, words: list[str]) -> dict[str, int]:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each of the given words over all documents; as many rows as words pass the driver."""
    found = docs.select(F.explode(F.array_append(F.array_intersect(_words(F.col(text)), F.lit(words)), F.lit(""))).alias("w"))
    df = dict(map(tuple, found.groupBy("w").count().collect()))
    n = df.get("", 0)
    return {w: math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(w, 0) + 1))) for w in words}


def index_rows(templates: Sequence[Template], idf: dict[str, int]) -> list[tuple]:
    """(anchor, template, phrase, start, at, words, idf): of each phrase its word of highest idf, the first of equal ones, and its place in it."""
    rows = []
    for t, template in enumerate(templates):
        for k, (phrase, start) in enumerate(zip(template.phrases, template.starts(), strict=True)):
            words = phrase.split()
            at = max(range(len(words)), key=lambda j: (idf[words[j]], -j))
            rows.append((words[at], t, k, start, at, words, sum(idf[w] for w in words)))
    return rows


def occurrences(docs: DataFrame, key: str, text: str, anchors: list[str], reach: int) -> DataFrame:
    """(row, key, n_words, hits): of every document the places of anchors, with the words at most ``reach`` - 1 before and after; one row a document."""

    def of(words: Column) -> Column:
        near = lambda x: F.slice(words, F.greatest(x["pos"] - reach + 2, F.lit(1)), F.lit(2 * reach - 1))
        placed = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: x["word"].isin(anchors))
        hits = F.transform(placed, lambda x: F.struct(x["pos"].alias("pos"), x["word"].alias("word"), near(x).alias("near")))
        return F.struct(F.size(words).cast("long").alias("n_words"), F.when(F.arrays_overlap(words, F.lit(anchors)), hits).alias("hits"))

    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), once(_words(F.col(text)), of).alias("x"))
    return found.select("row", "key", "x.n_words", "x.hits")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", own: Sequence[Template] = tuple(OWN), base: Sequence[Template] = tuple(BASE), slack: int = SLACK) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs.

    A label is given where all key phrases of one of its templates stand, each word for word, at places that agree with the wording
    within ``slack`` words (surely; some pairs up to twice as far apart also share a window). n_base counts the places of base phrases, first_word and last_word are their smallest and largest
    (null without any). score is the largest share, by idf, of a template's key phrases found together; 1 with any label. A
    null or empty text has no words and no label; rows that repeat a key and null keys have their own result; an empty table gives
    no rows. Other columns are not read. Counts and idf cover all documents. Places of a phrase in a long text are rows, so
    one text of many places is split like any other rows.
    """
    templates = [*base, *own]
    rows = index_rows(templates, rarity(docs, text, vocabulary(templates)))
    reach = max(len(r[5]) for r in rows)
    spark = docs.sparkSession
    index = spark.createDataFrame(rows, "word string, template int, phrase int, start int, at int, words array<string>, idf long")
    about = spark.createDataFrame([(t, x.label, x.base, len(x.phrases), sum(r[6] for r in rows if r[1] == t)) for t, x in enumerate(templates)], "template int, label string, base boolean, n_phrases int, all_idf long")
    found = stage(occurrences(docs, key, text, sorted({r[0] for r in rows}), reach), "occurrences")

    hits = found.where("hits is not null").select("row", F.explode("hits").alias("x")).select("row", "x.*")
    # where the phrase and the whole template would begin, by this posting; the words that stand there
    hits = hits.join(F.broadcast(index), "word").withColumn("place", F.col("pos") - F.col("at")).withColumn("origin", F.col("place") - F.col("start")).where("place >= 0")
    stands = F.slice("near", F.least("pos", F.lit(reach - 1)) - F.col("at") + 1, F.size("words")) == F.col("words")
    hits = hits.withColumn("verified", stands).drop("near", "words", "word")
    # origins that differ by at most the slack share one of two windows of twice its width, shifted by half
    width = 2 * slack + 2
    shifts = F.array(*[F.struct(F.lit(s).alias("shift"), F.floor((F.col("origin") + s * (slack + 1)) / width).alias("window")) for s in (0, 1)])
    near = hits.withColumn("x", F.explode(shifts)).select("*", "x.shift", "x.window").groupBy("row", "template", "shift", "window", "phrase")
    near = near.agg(F.max("verified").alias("verified"), F.first("idf").alias("idf")).groupBy("row", "template", "shift", "window")
    near = near.agg(F.count("*").alias("agree"), F.count_if("verified").alias("n"), F.sum(F.when(F.col("verified"), F.col("idf")).otherwise(F.lit(0))).alias("got"))
    near = near.join(F.broadcast(about), "template").withColumn("whole", (F.col("agree") == F.col("n_phrases")) & (F.col("n") == F.col("n_phrases")))
    share = F.when(F.col("whole"), F.lit(1.0)).otherwise(F.col("got") / F.greatest("all_idf", F.lit(1)))
    given = near.groupBy("row").agg(F.collect_set(F.when(F.col("whole"), F.col("label"))).alias("labels"), F.collect_set(F.when(F.col("whole") & F.col("base"), F.col("label"))).alias("base_labels"), F.max(share).alias("score"))
    places = hits.where("verified").join(F.broadcast(about.where("base")), "template").select("row", "template", "place").distinct()
    places = places.groupBy("row").agg(F.count("*").alias("n_base"), F.min("place").cast("long").alias("first_word"), F.max("place").cast("long").alias("last_word"))

    joined = lambda c: F.coalesce(F.array_join(F.sort_array(c), ","), F.lit(""))
    out = found.select("row", "key", "n_words").join(given, "row", "left").join(places, "row", "left")
    out = stage(out.select(F.col("key").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", joined("base_labels").alias("base_labels"), joined("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")), "licences")
    release(found)
    return out


def _sql() -> str:
    """The twin: every place of every phrase by comparing words, idf, and the same windows of origins."""
    templates = [*BASE, *OWN]
    phrases = [(t, x.label, x.base, k, s, p.split()) for t, x in enumerate(templates) for k, (p, s) in enumerate(zip(x.phrases, x.starts(), strict=True))]
    quoted = ", ".join(f"({t}, '{label}', {base}, {k}, {s}, {words!r})" for t, label, base, k, s, words in phrases)
    width = 2 * SLACK + 2
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {duck_words("text")} AS w FROM documents),
phrase(template, label, base, k, start, ws) AS (VALUES {quoted}),
df AS (SELECT x.word, (SELECT count(*) FROM d WHERE list_contains(d.w, x.word)) AS df FROM (SELECT DISTINCT unnest(ws) AS word FROM phrase) x),
idf AS (SELECT word, floor(1000.0 * ln((2.0::DOUBLE * (SELECT count(*) FROM d) + 2.0) / (2.0::DOUBLE * df + 1.0)))::BIGINT AS idf FROM df),
valued AS (SELECT p.*, (SELECT sum(list_extract(m, 1)) FROM (SELECT [idf] AS m FROM (SELECT unnest(p.ws) AS word) u JOIN idf USING (word))) AS idf FROM phrase p),
head AS (SELECT r, pos FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS pos FROM d) WHERE w[pos] IN (SELECT ws[1] FROM phrase)),
place AS (SELECT r, template, label, base, k, idf, pos - 1 AS place, pos - 1 - start AS origin FROM head JOIN d USING (r) JOIN valued ON d.w[pos : pos + len(ws) - 1] = ws),
total AS (SELECT template, count(*) AS n_phrases, sum(idf) AS all_idf FROM valued GROUP BY template),
near AS (
  SELECT r, template, label, base, count(DISTINCT k) = n_phrases AS whole, sum(idf) / greatest(all_idf, 1) AS share
  FROM (SELECT DISTINCT r, template, label, base, k, idf, shift, floor((origin + shift * {SLACK + 1}) / {width}.0) AS win FROM place, (VALUES (0), (1)) s(shift)) JOIN total USING (template)
  GROUP BY r, template, label, base, shift, win, n_phrases, all_idf),
given AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole AND base) AS base_labels,
    max(CASE WHEN whole THEN 1.0::DOUBLE ELSE share::DOUBLE END) AS score FROM near GROUP BY r),
places AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM place WHERE base GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN given USING (r) LEFT JOIN places USING (r)"""


SQL = _sql()
