"""The persisted index and its store: passes over changing files, retries, a forced failure, snapshots, buckets in the plan."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.operators import postings
from quillon.operators.snapshots import Conflict, Store

LISTING = "path string, size long, mtime long, hash string"
WORD = re.compile(r"[^\W_]+").findall


def listing(spark, files, mtime=0):
    return spark.createDataFrame([(p, len(t or ""), m, str(t)) for p, (t, m) in files.items()], LISTING)


def reader(spark, files):
    """Extraction from a dict; a text may be an error of a kind."""

    def extract(due):
        rows = []
        for p, (t, _) in files.items():
            kind = t.split(":")[0] if t and t.startswith(("retry:", "unsupported:", "broken:")) else None
            chunks = [] if kind or not t else [(x.split(" ")[0], x) for x in t.split("\n")]
            rows.append((p, f"title of {p}", chunks, "cannot" if kind else None, kind))
        all_ = spark.createDataFrame(rows, "path string, title string, chunks array<struct<section string, text string>>, error string, kind string")
        read.append(sorted(r.path for r in due.collect()))
        return all_.join(due.select("path"), "path")

    read: list = []
    extract.read = read
    return extract


def plain(files, question, k):
    """BM25 over (path, chunk) of {path: text}."""
    chunks = {(p, i): (x, x.split(" ")[0], f"title of {p}") for p, t in files.items() for i, x in enumerate(t.split("\n"))}
    words = {c: [WORD(x.lower()) for x in cols] for c, cols in chunks.items()}
    mean = sum(len(x) for w in words.values() for x in w) / len(words)
    score = defaultdict(float)
    for q in dict.fromkeys(question):
        fits = lambda t: t == q or (len(q) >= 4 and t.startswith(q))  # noqa: B023, E731
        tf = {c: sum(wt * sum(map(fits, x)) for wt, x in zip((1.0, 0.6, 0.4), w, strict=True)) for c, w in words.items()}
        tf = {c: f for c, f in tf.items() if f > 0}
        idf = max(math.log((len(words) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6) if tf else 0
        for c, f in tf.items():
            n = sum(map(len, words[c]))
            score[c] += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))
    order = sorted(score, key=lambda c: (-round(score[c], 9), c))[:k]
    return [(*c, round(score[c], 6)) for c in order]


def answers(now, spark, question, k=5):
    asked = spark.createDataFrame([(1, question)], "question long, words array<string>")
    return [(r.path, r.chunk, round(r.score, 6)) for r in postings.ask(now, asked, k).orderBy("place").collect()]


def test_passes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    one = {"a": ("red apples grow\nin the garden", 0), "b": ("blue sky", 0), "c": ("retry:", 0), "d": ("unsupported:", 0), "e": ("", 0), "g": ("red sky at night", 0), "h": ("goes away red", 0)}
    extract = reader(spark, one)
    first = postings.update(store, listing(spark, one), extract, 8)
    assert extract.read == [sorted(one)]
    state = lambda now: {r.path: (r.status, r.n_chunks, r.version) for r in now.table("files").collect()}
    assert state(first) == {"a": ("indexed", 2, 1), "b": ("indexed", 1, 1), "c": ("waiting", 0, 0), "d": ("ignored", 0, 1), "e": ("problem", 0, 1), "g": ("indexed", 1, 1), "h": ("indexed", 1, 1)}
    texts = {"a": one["a"][0], "b": "blue sky", "g": "red sky at night", "h": "goes away red"}
    for q in (["red"], ["app", "apple", "sky"], ["gard", "night", "the"], ["title", "of"], ["absent"], []):
        assert answers(first, spark, q) == plain(texts, q, 5)

    # changed, touched, still waiting, away, new, now unsupported, a file that worked and waits now
    two = {"a": ("green apples only", 1), "b": ("blue sky", 5), "c": ("retry:", 0), "d": ("unsupported:", 0), "e": ("", 0), "g": ("retry:", 2), "i": ("new red file", 0)}
    extract = reader(spark, two)
    second = postings.update(store, listing(spark, two), extract, 8)
    assert extract.read == [["a", "c", "g", "i"]]  # only what changed or waits is read
    assert state(second) == {"a": ("indexed", 1, 2), "b": ("indexed", 1, 1), "c": ("waiting", 0, 0), "d": ("ignored", 0, 1), "e": ("problem", 0, 1), "g": ("waiting", 1, 1), "i": ("indexed", 1, 2)}
    texts = {"a": "green apples only", "b": "blue sky", "g": "red sky at night", "i": "new red file"}
    for q in (["red"], ["apples", "sky"], ["garden"], ["title", "file"]):
        assert answers(second, spark, q) == plain(texts, q, 5)
    assert answers(first, spark, ["garden"]) != []  # a reader of the first state is unmoved
    packed = postings.compact(store)
    assert [len(packed.tables[x]["parts"]) for x in ("postings", "chunks")] == [1, 1] and packed.table("postings").count() < second.table("postings").count()
    for q in (["red"], ["apples", "sky"], ["title", "file"]):
        assert answers(packed, spark, q) == answers(second, spark, q)

    # what waited comes back, what is read becomes a problem and loses its chunks
    three = {**two, "c": ("at last readable", 0), "a": ("broken:", 9), "g": ("red again", 2)}
    third = postings.update(store, listing(spark, three), reader(spark, three), 8)
    assert {p: x[0] for p, x in state(third).items() if p in "acg"} == {"a": "problem", "c": "indexed", "g": "indexed"}
    assert answers(third, spark, ["red", "readable"]) == plain({"b": "blue sky", "c": "at last readable", "g": "red again", "i": "new red file"}, ["red", "readable"], 5)
    store.clean(1)
    assert store.versions() == [4] and answers(store.snapshot(), spark, ["blue"]) == [("b", 0, answers(third, spark, ["blue"])[0][2])]


def test_empty_index(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    now = postings.update(store, spark.createDataFrame([], LISTING), reader(spark, {"x": ("y", 0)}), 4)
    assert now.table("files").count() == 0 and answers(now, spark, ["word"]) == []


def test_a_pass_that_dies_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/index")
    one = {"a": ("red apples", 0)}
    before = postings.update(store, listing(spark, one), reader(spark, one), 4)
    two = {"a": ("green pears", 1), "b": ("red", 0)}

    def dies(due):
        return reader(spark, two)(due).withColumn("title", F.when(F.col("path") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("title")))

    with pytest.raises(Exception, match="lost"):
        postings.update(store, listing(spark, two), dies, 4)
    assert store.versions() == [1] and answers(store.snapshot(), spark, ["red"]) == answers(before, spark, ["red"]) != []
    # between two tables of one change
    with pytest.raises(RuntimeError, match="between"), store.change() as c:
        c.put("files", spark.range(3).toDF("x"))
        raise RuntimeError("between")
    assert store.snapshot().table("files").columns != ["x"]
    again = postings.update(store, listing(spark, two), reader(spark, two), 4)
    assert again.version == 2 and answers(again, spark, ["green"]) != []


def test_two_writers_of_one_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(Conflict), store.change() as slow:
        with Store(spark, store.path).change() as fast:
            fast.put("t", spark.range(1))
        slow.put("t", spark.range(2))
    assert store.snapshot().table("t").count() == 1 and store.snapshot(0).tables == {}
    held = store.snapshot()
    with store.change() as c:
        c.append("t", spark.range(5))
        c.notes["n"] = 1
    assert held.table("t").count() == 1 and store.snapshot().table("t").count() == 6 and store.snapshot().notes == {"n": 1}


def test_a_question_reads_its_buckets_only(spark, tmp_path, capsys):
    store = Store(spark, f"file://{tmp_path}/index")
    files = {f"f{k}": (" ".join(f"{chr(97 + j % 26)}{chr(97 + j * 7 % 26)}word{j}" for j in range(k, k + 60)), 0) for k in range(20)}
    now = postings.update(store, listing(spark, files), reader(spark, files), 16)
    found = postings.ask(now, spark.createDataFrame([(1, ["bhword1"])], "question long, words array<string>"), 3)
    assert Counter(r.path for r in found.collect()).total() == 2
    found.explain("formatted")
    told = capsys.readouterr().out
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)|PartitionFilters: \[[^\]]*\(bucket#\d+ = \d+\)", told)
    sizes = now.table("postings").groupBy("bucket").count().collect()
    assert len(sizes) > 8 and all(r["count"] for r in sizes)
