"""Stages of the pipeline on unusual tables: empty ones, nulls, repeated rows, extra columns, no n_chars."""

from __future__ import annotations

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, source string, lang string, _w string, label string"
LONG = " ".join(f"mot{k}" for k in range(20000))
ROWS = [
    (1, "une ligne de texte assez longue pour compter\nune autre ligne sans rapport", "a", "fr", "x", None),
    (2, "une ligne de texte assez longue pour compter\nsa propre fin de texte", "a", "fr", None, "y"),
    (3, None, None, None, None, None),
    (4, "", "b", "fr", "x", "y"),
    (5, LONG, "b", "fr", "x", "y"),
    (5, LONG, "b", "fr", "x", "y"),
]


def test_lines_without_n_chars(spark, sf):
    found = cp.lines(spark, spark.createDataFrame(ROWS, SCHEMA), sf)
    assert found.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    rows = found.collect()
    assert len(rows) == len(ROWS)
    texts = {r.doc_id: r.text for r in rows if r.doc_id != 5}
    assert texts[1] == ROWS[0][1] and texts[2] == "sa propre fin de texte" and not texts[3] and not texts[4]
    assert [r["_w"] for r in rows if r.doc_id == 1] == ["x"] and [r["label"] for r in rows if r.doc_id == 2] == ["y"]
    assert LONG in [r.text for r in rows if r.doc_id == 5]


def test_empty_table(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for _, step in cp.STAGES:
        found = step(spark, docs, sf)
        assert found.count() == 0
        docs = found if found.columns == docs.columns else docs


def test_near_copies_of_repeated_rows(spark, sf):
    found = cp.near_copies(spark, spark.createDataFrame(ROWS, SCHEMA), sf)
    assert sorted(r.doc_id for r in found.collect()) == [1, 2, 3, 5, 5]
