"""One test for each finding of round 3's review that held."""

from __future__ import annotations

from quillon.plans import registry
from tests.oracle import check

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_metrics_of_a_question_without_a_relevant_result(spark, tmp_path):
    # no other vector has the label of vector 0; all of vector 100's have its own
    rows = [(k, "alone" if k == 0 else "same", [1.0, k / 200]) for k in range(130)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    (part,) = (tmp_path / "embeddings.parquet").glob("*.parquet")
    part.rename(tmp_path / "part.parquet")
    sf = tmp_path / "sf"
    sf.mkdir()
    (tmp_path / "part.parquet").rename(sf / "embeddings.parquet")
    check(spark, QUERIES["retrieval_metrics"], str(sf), SQL["retrieval_metrics"])


def test_near_pairs_where_they_meet(spark, monkeypatch):
    """Keys of two to many rows, over several batches: no pair of a small key is lost, and only the members of large ones leave."""
    import random
    from itertools import combinations

    from quillon.llm import simhash

    monkeypatch.setattr(simhash, "SMALL", 16)
    monkeypatch.setattr(simhash, "DENSE", 100)
    random.seed(5)
    sizes = [1, 2, 3, 16, 17, 5, 40, 1, 300, 2, 16]
    rows = [(k, 1000 * k + j, random.getrandbits(64) if j % 3 else 7 ^ (1 << random.randrange(60))) for k, n in enumerate(sizes) for j in range(n)]
    rows = [(k, x, fp - (1 << 64) if fp >> 63 else fp) for k, x, fp in rows]
    near = lambda a, b: bin((a[2] ^ b[2]) & ((1 << 64) - 1)).count("1") <= 4
    df = spark.createDataFrame(rows, "key long, node long, fp long").coalesce(1).sortWithinPartitions("key", "node")
    for batch in ("10000", "7", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found = simhash.met(df, 4).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        led = {(r.node, r.other) for r in found if r.key is None and r.led}
        free = {(r.node, r.other) for r in found if r.key is None and not r.led}
        by = {k: [r for r in rows if r[0] == k] for k in range(len(sizes))}
        assert led == {(b[1], own[0][1]) for own in by.values() for b in own[1:] if near(own[0], b)}
        assert free == {(b[1], a[1]) for own in by.values() if len(own) <= simhash.SMALL for a, b in combinations(own[1:], 2) if near(a, b)}
        assert sorted((r.key, r.node, r.fp) for r in found if r.key is not None) == sorted(r for k, own in by.items() if len(own) > simhash.SMALL for r in own)
    monkeypatch.setattr(simhash, "SMALL", 4096)
    monkeypatch.setattr(simhash, "DENSE", 1)
    close = [(1, x, 7 ^ (1 << x)) for x in range(60)] + [(2, 99, 7), (2, 100, 6), (2, 101, ~7)]
    df = spark.createDataFrame(close, "key long, node long, fp long").coalesce(1).sortWithinPartitions("key", "node")
    found = simhash.met(df, 4).collect()
    assert {r.node for r in found if r.key == 1} == set(range(60)) and {r.key for r in found} == {1, None}
    assert {(r.node, r.other) for r in found if r.key is None} == {(x, 0) for x in range(1, 60)} | {(100, 99)}


def test_counts_of_ngrams():
    from collections import Counter

    from quillon.llm import langid

    def plain(text):
        words = "".join(c if c.isalpha() else " " for c in " ".join(langid.WORD(text.lower()))).split()
        return Counter(f" {x} "[i : i + k] for x in words for k in range(1, 6) for i in range(len(x) + 3 - k) if k > 1 or 0 < i <= len(x))

    for text in ("", "a", "The cat and the catalogue", "½the²and of", "É́ coleÉcole 12_x\x0b\ny", "ab " * 50):
        want = plain(text)
        for piece in (1 << 20, 10):
            langid.PIECE, before = piece, langid.PIECE
            grams, counts = langid.count(text)
            langid.PIECE = before
            assert sorted(counts.tolist()) == sorted(want.values()) and len(set(grams.tolist())) == len(want)


def test_rows_of_a_table_held_at_once(spark):
    from pathlib import Path

    import pyarrow.parquet as pq

    from quillon.llm.common import stage

    table = stage(spark.range(0, 50, 1, 1), "large rows", 4)
    files = [pq.ParquetFile(x) for x in Path(table._quillon_path.replace("file://", "")).glob("*.parquet")]
    assert max(f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)) == 4 and table.count() == 50
