"""What grows with the tables: shuffles in plans, rows held in Python, tasks of a join."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F

from quillon.operators import html_clean, postings, tables, text_units


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_of_the_index_are_not_shuffled(spark, tmp_path):
    rows = [("a", 0, "the title", "red", "red apples, red pears", 7, 1), ("b", 0, None, None, "", 0, 1)]
    spark.createDataFrame(rows, postings.CHUNKS).write.parquet(f"{tmp_path}/chunks")
    found = postings.postings(spark.read.parquet(f"{tmp_path}/chunks"), 8)
    assert "Exchange" not in plan(found)
    assert sorted((r.path, r.term, r.tf) for r in found.collect()) == [("a", "apples", 10), ("a", "pears", 10), ("a", "red", 26), ("a", "the", 4), ("a", "title", 4)]


def test_postings_of_documents_share_one_shuffle(spark):
    docs = spark.createDataFrame([(1, "red red sky"), (2, None), (3, "sky")], "doc_id long, text string")
    found = text_units.postings(docs, "doc_id", "text")
    per_doc = found.groupBy("doc_id").agg(F.sum("tf").alias("n"))
    assert len(re.findall(r"Exchange hashpartitioning", plan(per_doc))) == 1
    assert sorted(map(tuple, found.collect())) == [(1, "red", 2), (1, "sky", 1), (3, "sky", 1)] and sorted(map(tuple, per_doc.collect())) == [(1, 3), (3, 1)]


def test_pages_are_cleaned_a_few_at_a_time(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"<p>{k}</p>", "s") for k in range(200)], "page_id long, html string, slug string")
    seen, kind = [], type(pages)
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **k: (seen.append(f), whole(self, f, *a, **k))[1])
    found = html_clean.cleaned(pages, "page_id", "html", "slug", spark.createDataFrame([], "slug string, category string"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([f"<p>{k}</p>" for k in range(200)]), pa.array(["s"] * 200), pa.array([[]] * 200, pa.list_(pa.string())), pa.array([None] * 200, pa.list_(pa.string()))], ["page_id", "html", "slug", "assets", "articles"])
    made = list(seen[-1](iter([batch])))
    assert max(x.num_rows for x in made) == html_clean.LOT < 200 and [x for b in made for x in b.column(1).to_pylist()] == [f"<p>{k}</p>" for k in range(200)]
    assert found.count() == 200


def test_replaced_children_are_joined_in_small_tasks(spark):
    old = spark.range(1000, numPartitions=4).select((F.col("id") % 100).alias("k"), "id")
    found = tables.replace_children(old, old.where("id < 3"), old.where("k < 50").select("k"), "k")
    assert "hashpartitioning(k" in plan(found) and ", 32)" in plan(found)
    assert found.count() == 503
