"""One test for each finding of round 4's review that held."""

from __future__ import annotations

import random
import struct

from pyspark.sql import functions as F

from quillon.operators import postings
from quillon.operators import retrieval as rt
from quillon.operators.snapshots import Store
from quillon.plans import registry
from tests.oracle import check
from tests.test_index import answers, listing, plain, reader

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_metrics_are_of_every_vector(spark, tmp_path):
    random.seed(3)
    rows = [(k, k % 3, [random.randint(-9, 9) / 10 for _ in range(4)]) for k in range(150)]
    rows += [(1000 + k, k % 2, rows[7][2]) for k in range(40)]  # equal vectors tie
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/one")
    (part,) = (tmp_path / "one").glob("*.parquet")
    sf = tmp_path / "sf"
    sf.mkdir()
    part.rename(sf / "embeddings.parquet")
    check(spark, QUERIES["retrieval_metrics"], str(sf), SQL["retrieval_metrics"])
    assert QUERIES["retrieval_metrics"](spark, str(sf)).first().n == len(rows)


def test_nearest_in_small_lots_against_all_pairs(spark):
    random.seed(4)
    values = [[random.gauss(0, 1) for _ in range(5)] for _ in range(230)] + [[1.0, 0.5, 0.25, 0.0, -1.0]] * 60 + [[0.0] * 5] * 3
    values += [[1.0 + k * 1e-12, 0.5, 0.25, 0.0, -1.0] for k in range(20)] + [[1e30 * x for x in values[0]], [1e-30 * x for x in values[1]]]
    own = [(7 * k % 400, [float(x) for x in v]) for k, v in enumerate(values)]

    def dot(a, b):
        s = 0.0
        for x, y in zip(a, b, strict=True):
            s += x * y
        return s

    want = {q: sorted((-dot(a, b), v) for v, b in own if v != q)[:6] for q, a in own}
    df = spark.createDataFrame(own, "vec_id long, v array<double>")
    for held, lot in ((32768, 4096), (40, 17), (1000, 3)):
        found = rt.nearest(df.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), df, 6, held, lot).collect()
        got = {q: [] for q, _ in own}
        for r in sorted(found, key=lambda r: r["rank"]):
            got[r.query_id].append((-r.cosine, r.vec_id))
        assert got == want


def test_packed_postings_say_what_their_rows_say(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "LOT", 3)
    texts = ["red apples, RED pears", "", None, "Œuvre déjà vue: l’été à Łódź", "snake_case x²  ½ Ⅷ 12e", "ΣΑΣ привет 你好 — «ß»", "a\u0301b e\u0301\u0302", "— … —", "ap apple apples application", "tab\there\x00nul", "😀smile😀", "red"]
    rows = [(f"p{k % 4}", k // 4, [None, "A title", "Ébauche", ""][k % 4], [None, "red", "œil 2"][k % 3], t, 0, 7) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, postings.CHUNKS).coalesce(1).write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    found = postings.packed(chunks, 7, 8).collect()
    lots = {r.lot: list(zip(r.paths, r.ranks, r.n_words, strict=True)) for r in found if r.bucket == postings.INDEX}
    assert len(lots) == 4 and max(map(len, lots.values())) == 3 and all(r.version == 7 for r in found)
    got = []
    for r in (r for r in found if r.bucket != postings.INDEX):
        assert r.terms == sorted(r.terms)
        at, tf = struct.unpack(f"<{len(r['at']) // 2}H", r["at"]), struct.unpack(f"<{len(r.tf) // 4}i", r.tf)
        assert len(at) == len(tf) == r.ends[-1]
        for term, low, high in zip(r.terms, [0, *r.ends], r.ends):
            got += [(*lots[r.lot][at[k]][:2], term, tf[k], r.bucket) for k in range(low, high)]
    want = postings.postings(chunks, 8)
    assert sorted(got) == sorted((r.path, r["rank"], r.term, r.tf, r.bucket) for r in want.collect())
    words = {(p, k): n for x in lots.values() for p, k, n in x}
    count = lambda c: F.size(postings.tx.tokens(postings.tx.normalize(F.coalesce(c, F.lit("")))))
    assert words == {(r.path, r["rank"]): r.n for r in chunks.withColumn("n", count("text") + count("section") + count("title")).collect()}


def test_questions_over_many_lots_without_a_row_for_each_posting(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "LOT", 3)
    random.seed(9)
    words = ["red", "reds", "reddish", "sky", "skyline", "of", "apple", "apples", "zèbre", "12"]
    text = lambda: "\n".join(" ".join(random.choices(words, k=random.randint(1, 9))) for _ in range(random.randint(1, 5)))
    store = Store(spark, f"file://{tmp_path}/index")
    one = {f"f{k:02}": (text(), 0) for k in range(30)} | {f"same{k}": ("red sky of apple", 0) for k in range(9)}
    two = {p: (text(), 1) if k % 3 == 0 else x for k, (p, x) in enumerate(one.items()) if k % 7} | {"new": ("skyline of reddish zebre", 0)}
    postings.update(store, listing(spark, one), reader(spark, one), 8)
    now = postings.update(store, listing(spark, two), reader(spark, two), 8)
    texts = {p: t.replace("è", "e") for p, (t, _) in two.items()}
    asked = [["redd", "of"], ["red"], ["appl", "sky", "zebr"], ["12"], ["skyl", "red", "absent"], ["of", "red", "sky", "apple"]]
    for q in asked:
        assert answers(now, spark, q, 7) == plain(texts, q, 7)
    together = spark.createDataFrame(list(enumerate(asked)), "question long, words array<string>")
    monkeypatch.setattr(postings, "ASKED", 2)  # the questions in three blocks
    found = postings.ask(now, together, 7).collect()
    for q, w in enumerate(asked):
        assert [(r.path, r.chunk, round(r.score, 6)) for r in sorted(found, key=lambda r: r.place) if r.question == q] == plain(texts, w, 7)
    # one lot for a task's chunks: rows by bucket, however many words there are
    monkeypatch.setattr(postings, "LOT", 4096)
    long = {f"l{k}": ("\n".join(" ".join(f"w{random.randrange(3000)}" for _ in range(60)) for _ in range(20)), 0) for k in range(12)}
    store = Store(spark, f"file://{tmp_path}/long")
    now = postings.update(store, listing(spark, long), reader(spark, long), 4)
    assert now.table("chunks").count() == 240 and now.table("postings").count() <= 5 * spark.sparkContext.defaultParallelism
