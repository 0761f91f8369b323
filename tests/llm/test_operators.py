"""Operators against plain versions, on the smallest tables and on planted cases."""

import hashlib
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import langid, line_dedup, mixing, order_minhash, packing, quality_model, quality_rules, registry, simhash, suffix_dedup, token_files
from quillon.llm.common import components, documents, vocabulary, word_ids
from quillon.session import ship

SCHEMA = "doc_id long, text string, lang string, source string, key string, n long"


def planted():
    """Texts with copies, near copies, shared passages, ties, empties, nulls, long and odd ones."""
    random.seed(5)
    pool = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(random.choice(pool) for _ in range(n))
    passage, base = text(60), text(200)
    rows = [(1, base), (2, base), (3, base.upper()), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "two words"), (9, "ab " * 400), (10, text(30) + "\n" + passage + "\n" + text(20)), (11, passage), (12, "é ß 中文 " * 30 + passage)]
    for k in range(13, 33):
        words = base.split()
        words[random.randrange(len(words))] = text(1)
        rows.append((k, " ".join(words)))
    shared = text(20)
    for k in range(33, 50):
        own = shared.split()
        own[random.randrange(20)] = text(1)
        rows.append((k, text(40) + "\n" + " ".join(own) + "\n" + shared + "\n" + text(9) + "!! $$"))
    rows += [(50, text(3000)), (None, text(50)), (51, "x" * 5000), (52, "\n".join(["same line of five words"] * 9)), (53, "İstanbul ΣΑΣ don't I'LL 12³ ́á naïve"), (54, "it's 'S ''s a_b--c __ 7x7 ñandú"), (54, "it's 'S ''s a_b--c __ 7x7 ñandú")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    langs, sources = ["en", "fr", None], ["a", "b", None, "c"]
    rows = [(d, t, langs[k % 3], sources[k % 4], "k", k) for k, (d, t) in enumerate(planted())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (7, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_simhash(spark, sf, docs, none):
    for df in (docs, documents(spark, sf), none):
        found = simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id").collect()
        assert Counter(map(tuple, found)) == brute.simhash(pairs(df))
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} >= {1, None} and simhash.keep_one(none).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_simhash_hamming_join_is_exact(spark):
    random.seed(3)
    centres = [random.getrandbits(64) for _ in range(20)]
    fps = {c ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 6))) for c in centres for _ in range(30)} | {random.getrandbits(64) for _ in range(200)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f, f) for f in fps], "node long, fp long")
    roots = brute.groups(len(fps), lambda i, j: bin((fps[i] ^ fps[j]) & ((1 << 64) - 1)).count("1") <= 4)
    least = {}
    for f, r in zip(fps, roots, strict=True):
        least[r] = min(f, least.get(r, f))
    want = {f: least[r] for f, r in zip(fps, roots, strict=True)}
    for parts in (2, 4, None):
        found = {r.node: r.label for r in components(simhash.linked(df, parts=parts), "x", "y").collect()}
        assert {f: found.get(f, f) for f in fps} == want
    n, counts = simhash.bit_counts(df)
    given, cost = simhash.allocate(n, counts, simhash.arrange(n, counts, 2), 4)
    assert sum(t + 1 for t in given) == 5 and cost > 0
    assert sum(t + 1 for t in simhash.best_parts(n, counts, 6)[1]) == 7


def test_language(spark, sf, docs, none):
    training = documents(spark, sf)
    found = langid.identify(training, training).join(training.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    rows = {r.doc_id: r for r in langid.identify(docs, training).collect()}
    assert len(rows) == docs.select("doc_id").distinct().count() and all(0 <= r.score <= 1 for r in rows.values())
    assert [rows[k].lang_pred for k in (4, 5, 6)] == ["und"] * 3
    odd = spark.createDataFrame([(1, "½ ² Ⅷ 12 _"), (2, "½the²and of"), (3, "the and of")], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, training).collect()}
    assert found[1] == ("und", 0.0) and found[2] == found[3] != found[1]
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"} and langid.identify(none, training).count() == 0


def test_line_dedup(spark, sf, docs, none):
    for df in (docs, documents(spark, sf).where("n_chars < 4000"), none):
        assert {r.doc_id: r.lines for r in line_dedup.removed(df).collect()} == brute.removed_lines(pairs(df))
    clash = docs.withColumn("lines", F.lit("mine")).withColumn("_doc", F.lit(1))
    found = {(r.doc_id, r.n): r for r in line_dedup.dedup(clash).collect()}
    assert len(found) == docs.count() and all(r["lines"] == "mine" and r["lines_"].n_lines == (0 if t is None else t.count("\n") + 1) for r, t in ((found[d, n], t) for n, (d, t) in enumerate(planted())))
    assert next(r.text for (d, _), r in found.items() if d == 52) == "same line of five words"
    assert line_dedup.cleaned(docs).columns == docs.columns and line_dedup.cleaned(none).count() == 0


def test_line_dedup_of_long_texts(spark):
    """A line of more words than a window of bytes holds, a text of more lines than a lot, words longer than a window."""
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    long = [word() for _ in range(200_000)]
    near = [*long[:190_000], *(word() for _ in range(10_000))]
    many = "\n".join(f"{k} one two three four" for k in range(70_000)) + "\n0 one two three four"
    df = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(near)), (3, many), (4, "x" * 3_000_000 + " b c d e"), (5, "e d c b " + "x" * 3_000_000)], "doc_id long, text string")
    found = {r.doc_id: r.lines for r in line_dedup.removed(df).collect()}
    assert found == {2: [0], 3: [70_000], 5: [0]}


def test_line_dedup_of_large_groups(spark, sf):
    """The full join behind the streaming pass, keys that span batches, and rows in no order."""
    df = documents(spark, sf).where("n_chars < 4000").repartition(3, "text")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "5")
    try:
        want = brute.removed_lines(pairs(df))
        assert {r.doc_id: r.lines for r in line_dedup.removed(df, near=1).collect()} == want
        assert {r.doc_id: r.lines for r in line_dedup.removed(df, lot=64).collect()} == want
    finally:
        spark.conf.set(size, before)


def test_line_keys_share():
    """Any two similar sets share a key, whatever the counts of their words."""
    random.seed(9)
    for _ in range(400):
        level = {w: random.choice([3, 6, 12, 20]) for w in range(80)}
        a = set(random.sample(range(80), random.randint(4, 40)))
        b = {random.randrange(80) if random.random() < 0.1 else x for x in a}
        if a != b and min(len(a), len(b)) >= 4 and 5 * len(a & b) >= 4 * len(a | b):
            sets = [np.array(sorted(level[w] << 40 | w for w in s), np.uint64) for s in (a, b)]
            n = np.array([len(a), len(b)])
            found = [set(), set()]
            for key, owner, _ in line_dedup.keys(np.concatenate(sets), np.array([0, len(a)]), n, 0.8, 100.0, random.choice([1, 4, 50])):
                for k, o in zip(key.tolist(), owner.tolist()):
                    found[o].add(k)
            assert found[0] & found[1]


def test_line_words_hash_alike(monkeypatch):
    """The same words have the same hashes wherever they stand, and no white space enters them."""
    text = "é a\tbb\x0bccc\r\nbb  a\x0c é\x1c ".encode() * 50
    begin, found = line_dedup.hashed(text)
    words = text.split()
    assert [text[b : b + len(w)] for b, w in zip(begin.tolist(), words, strict=True)] == words
    assert len(set(zip(words, found.tolist()))) == len(set(words)) == len(set(found.tolist()))
    monkeypatch.setattr(line_dedup, "WINDOW", 7)
    assert (line_dedup.hashed(text)[1] == found).all() and len(line_dedup.hashed(b" ")[0]) == 0


def test_quality_rules(spark, sf, docs, none, labels):
    for df in (docs, documents(spark, sf)):
        found = quality_rules.measure(df).collect()
        for r in found:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.measures(r.text)
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    judged = quality_rules.quality(docs, labels)
    assert judged.count() == docs.count() and not judged.where("kept and base_failed").count() and judged.where("kept").count()
    assert quality_rules.quality(none, labels).count() == 0
    assert quality_rules.quality(docs.withColumn("kept", F.lit(1)), labels).where("kept").count()
    clash = docs.withColumns({"kept": F.lit("mine"), "n_words": F.lit(-1), "_w": F.lit("w"), "stratum": F.lit(0)})
    found = quality_rules.accepted(clash, labels)
    assert found.columns == clash.columns and found.count() == judged.where("kept").count() == found.where("kept = 'mine' and n_words = -1 and _w = 'w'").count()


def test_thresholds_keep_clean_and_reject_junk(spark):
    random.seed(1)
    rows = [(k, ("w%d " * 60) % tuple(random.sample(range(10**6), 60)) + "$ " * (30 if k % 10 == 0 else 0), "en") for k in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = df.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("quality"))
    found = quality_rules.quality(df, marks).where("not base_failed").groupBy(F.col("doc_id") % 10 == 0).agg(F.avg(F.col("kept").cast("int"))).collect()
    rates = dict(map(tuple, found))
    assert rates[False] > 0.98 and rates[True] < 0.01


def test_mixing(spark, sf, docs, none):
    for df in (docs, documents(spark, sf)):
        rows = mixing.mix(df).collect()
        total = sum(r._size for r in rows)
        sizes, goals, taken = Counter(), {}, Counter()
        for r in rows:
            sizes[r.source] += r._size
            goals[r.source] = r.target
            taken[r.source] += r.copies * r._size
            assert r._size == len(brute.WORDS(r.text or "")) and 0 <= r.copies <= 3
        names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        open_, left, want = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, total, {}
        while open_:
            share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
            over = [s for s in open_ if share[s] > 3 * sizes[s]]
            if not over:
                want |= share
                break
            for s in over:
                want[s] = 3 * sizes[s]
                left -= want[s]
                del open_[s]
        assert goals == pytest.approx(want)
        for s, g in goals.items():
            assert abs(taken[s] - g) <= max(r._size for r in rows if r.source == s)
    assert Counter(map(tuple, mixing.mixed(docs).collect())) == Counter(map(tuple, mixing.mixed(docs).collect())) and mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0
    clash = docs.withColumns({"target": F.lit("mine"), "copies": F.lit(-1), "_size": F.lit("s"), "_u": F.lit(0)})
    assert mixing.mixed(clash).columns == clash.columns and mixing.mixed(clash).where("target = 'mine' and copies = -1 and _size = 's'").count() == mixing.mixed(docs).count()


def test_suffix_array():
    random.seed(1)
    for _ in range(600):
        x = [random.randint(1, random.choice([1, 2, 6])) for _ in range(random.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_suffix_dedup(spark, sf, docs, none, monkeypatch):
    real = documents(spark, sf).where("n_chars < 3000")
    for df in (docs.where("doc_id is not null"), real):
        rows = df.select("doc_id", "text")
        found = {r.doc_id: r.spans for r in suffix_dedup.spans(rows).collect()}
        for d, (n, gone, count, left) in brute.spans(pairs(df)).items():
            own = found.get(d) or []
            assert (sum(x.end - x.start for x in own), len(own)) == (gone, count)
    full = rows.join(suffix_dedup.spans(rows), "doc_id", "left")
    want = brute.spans(pairs(real))
    assert all(bytes(r.kept) == want[r.doc_id][3] for r in suffix_dedup.kept(full).collect())
    assert suffix_dedup.spans(docs).count() and suffix_dedup.spans(none).count() == 0
    segments, ids = [b"q" * 70, b"q" * 60 + b"r" * 30], [5, 2]
    whole = suffix_dedup.in_portions(segments, ids, 50)
    monkeypatch.setattr(suffix_dedup, "PORTION", 64)
    spread = suffix_dedup.in_portions(segments, ids, 50)
    assert [{x for a, b in r for x in range(a, b + 1)} for r in whole] == [{x for a, b in r for x in range(a, b + 1)} for r in spread] == [set(range(21)), set()]


def test_suffix_array_of_windows_is_quick():
    """Sorting a megabyte of segments, once built symbol by symbol, takes array time; and one hash beyond PORTION is not hashed anew for each lot."""
    import time

    rng = random.Random(3)
    segments = [bytes(rng.choices(b"abcd", k=70)) for _ in range(7000)]
    segments += [x[:60] + b"tail" * 3 for x in segments]
    ids = list(range(len(segments), 0, -1))
    began = time.process_time()
    found = suffix_dedup.earliest(segments, ids, 50)
    assert time.process_time() - began < 4
    assert found[:7000] == [[(0, 10)]] * 7000 and found[7000:] == [[]] * 7000


def test_portions_equal_the_whole(monkeypatch):
    rng = random.Random(4)
    base = [bytes(rng.choices(b"ab", k=60)) for _ in range(40)]
    segments = list(dict.fromkeys(rng.choice(base)[: rng.randint(50, 60)] + bytes(rng.choices(b"ab", k=rng.randint(0, 60))) for _ in range(400)))
    ids = [rng.randint(1, 300) for _ in segments]
    whole = suffix_dedup.in_portions(segments, ids, 50)
    least = {}
    for x, d in zip(segments, ids, strict=True):
        for o in range(len(x) - 49):
            least[x[o : o + 50]] = min(d, least.get(x[o : o + 50], d))
    plain = [[o for o in range(len(x) - 49) if least[x[o : o + 50]] < d] for x, d in zip(segments, ids, strict=True)]
    assert [[o for a, b in r for o in range(a, b + 1)] for r in whole] == plain
    monkeypatch.setattr(suffix_dedup, "PORTION", 500)
    assert suffix_dedup.in_portions(segments, ids, 50) == whole


def test_query_suffix(spark, sf):
    want = brute.spans(pairs(documents(spark, sf)))
    for r in registry.op6_suffix_dedup(spark, sf).collect():
        n, gone, count, left = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, count, hashlib.sha256(left).hexdigest())


def test_word_ids(spark, sf, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    texts = [t for _, t in pairs(docs)] + [t for _, t in pairs(documents(spark, sf))]
    for t, found in zip(texts, word_ids(vocabulary()).texts([t and t.encode() for t in texts]), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_word_ids_of_added_tokens():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    texts = ["a<|endoftext|>b", "<|startoftext|> x", "<|endoftext|>", "x <|endoftext|><|endoftext|>. y's", "<|ENDOFTEXT|> <|endoftext |>", "é\t<|endoftext|>\nß", "中<|startoftext|>b c", "a\x0b<|endoftext|>", "y" * 300 + "<|endoftext|> z"]
    found = [np.frombuffer(x, "<u4").tolist() for x in word_ids(vocabulary()).texts([t.encode() for t in texts])]
    assert found == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert found[0] == [320, 49407, 321]


def test_word_ids_of_all_plain_characters():
    """Every character, alone and between letters, digits and marks, as the library encodes it."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    chars = [chr(c) for c in [*range(1, 0x250), *range(0x2000, 0x2070), 0x301, 0x3042, 0x1F600] if not 0xD800 <= c < 0xE000]
    texts = [t for c in chars for t in (c, f"a{c}b", f"I'LL{c}7x{c}{c}'S", f"_{c}'{c}d")]
    texts += [" ".join(texts), "x" * 300 + " it's", "it's " + "y" * 257, "''s '''ll don''t 12'3 a_b__c"]
    for t, found in zip(texts, word_ids(vocabulary()).texts([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
    assert word_ids(vocabulary()).known


def test_packing(spark, sf, docs, none):
    for df in (docs, documents(spark, sf)):
        rows = packing.packed(df, vocabulary(), 256).collect()
        ends = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        assert max(ends.values()) <= 256 and set(ends) == set(range(len(ends)))
        texts = pairs(df)
        want = Counter()
        for (d, _), ids in zip(texts, word_ids(vocabulary()).texts([t and t.encode() for _, t in texts]), strict=True):
            ids += b"\0\0\0\0"
            want.update((d, k, a // 4, min(len(ids) - a, 1024) // 4, zlib.crc32(ids[a : a + 1024])) for k, a in enumerate(range(0, len(ids), 1024)))
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        least = -(-sum(r.length for r in rows) // 256)
        assert len(ends) <= least * 1.02 + 2
    assert packing.packed(none, vocabulary()).count() == 0
    with pytest.raises(ValueError, match="length"):
        packing.pack(spark.createDataFrame([(1, 0, 3000)], "doc_id long, piece long, length long"))


def test_plan_is_tight():
    rng = np.random.default_rng(2)
    counts = np.bincount(np.minimum(rng.lognormal(6, 1, 60000).astype(int) + 1, 2048), minlength=2049)
    made = packing.plan(counts)
    again = np.zeros_like(counts)
    for items, n in made:
        assert sum(v * m for v, m in items.items()) <= 2048
        for v, m in items.items():
            again[v] += m * n
    assert (again == counts).all()
    assert sum(n for _, n in made) <= 1.003 * (counts @ np.arange(2049)) / 2048 + 1


def test_token_files(spark, sf, docs, none, tmp_path):
    for df in (docs, documents(spark, sf)):
        shards = token_files.write(df, vocabulary())
        rows = sorted(token_files.read(shards).collect(), key=lambda r: r.start)
        texts = sorted(pairs(df), key=lambda x: (x[0] is not None, x[0] or 0))
        at = 0
        for r, (d, _), ids in zip(rows, texts, word_ids(vocabulary()).texts([t and t.encode() for _, t in texts]), strict=True):
            ids += np.array([2], "<u4").tobytes()
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids) // 4, zlib.crc32(ids))
            at += len(ids) // 4
    assert token_files.read(token_files.write(none, vocabulary())).count() == 0
    data = [(k, np.full(40000, k, "<u4").tobytes()) for k in range(10)]
    uri = f"file://{tmp_path}/x.zst"
    token_files.write_file(uri, iter(data))
    file = token_files.TokenFile(uri)
    assert file.document(9) == data[9][1] and file.frames_read <= 2
    raw = bytearray((tmp_path / "x.zst").read_bytes())
    raw[10] ^= 255
    (tmp_path / "x.zst").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017
        token_files.TokenFile(uri).document(0)


def test_quality_model(spark, docs, none, labels):
    big = "/root/testdata/sf0.01"
    found = registry.op9_quality_model(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out")
    assert found.where((F.col("quality") > 0) == (F.col("predicted") > 0)).count() >= 0.9 * found.count()
    rows = quality_model.featured(docs)
    for marks in (labels, labels.where("false")):
        scores = quality_model.scored(rows, quality_model.train(rows, marks)).collect()
        assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality_model.scored(quality_model.featured(none), None).count() == 0


def test_order_minhash(spark, docs, none):
    df = order_minhash.fingerprint(docs, "text", "fp")
    rows = {r.n: r for r in df.withColumn("s", order_minhash.written("fp")).withColumn("one", order_minhash.likeness("fp", "fp")).collect()}
    assert rows[0].s == rows[1].s and rows[0].s != rows[2].s and rows[3].s == rows[4].s == "" and all(r.one == 1 for r in rows.values())
    assert order_minhash.fingerprint(none, "text", "fp").count() == 0
    two = spark.createDataFrame([(" ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in [*range(200, 400), *range(200)]), " ".join(f"w{i}" for i in range(390)), " ".join(f"v{i}" for i in range(400)))], "a string, b string, c string, d string")
    for c in "abcd":
        two = order_minhash.fingerprint(two, c, "f" + c)
    r = two.select(order_minhash.likeness("fa", "fb").alias("swapped"), order_minhash.likeness("fa", "fc").alias("near"), order_minhash.likeness("fa", "fd").alias("far")).first()
    assert r.near > 0.8 > r.swapped > r.far == 0


def test_query_order_minhash(spark, sf):
    rows = sorted(pairs(documents(spark, sf)), key=lambda x: -x[0])
    found = {r.doc_id: r for r in registry.op10_order_minhash(spark, sf).collect()}
    assert len(found) == len(rows)
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1] or ""
        half = len(t or "") // 2
        edited = (t or "")[: len(t or "") - half] + after[:half]
        assert found[d].n_chars == len(t or "") and found[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        nxt = found[rows[(k + 1) % len(rows)][0]]
        assert (found[d].near_next == 1) == (found[d].fingerprint == nxt.fingerprint)


def test_near_copies_by_similarity(spark):
    """Whatever goes has a chain of similar texts to a smaller doc_id that stays; recall by similarity; equal words always meet."""
    random.seed(11)
    pool, rows, sets = [f"w{k}" for k in range(4000)], [], {}
    for k in range(120):
        base = random.sample(pool, 300)
        rows.append((10 * k, " ".join(base)))
        for m in range(1, 4):
            own = list(base)
            for at in random.sample(range(300), 3 * m if k % 2 else 2 * m - 1):
                own[at] = random.choice(pool)
            rows.append((10 * k + m, " ".join(own)))
    rows += [(5000, rows[0][1].upper()), (5001, "a b"), (5002, "A  b"), (5003, " "), (5004, None), (None, "a b"), (None, "free"), (5005, "c d"), (5005, "a b"), (5006, "c d")]
    df = spark.createDataFrame([(d, t, "en", "a", "k", 0) for d, t in rows], SCHEMA).withColumn("_gone", F.lit(1)).repartition(3)
    found = simhash.keep_one(df)
    assert found.columns == df.columns
    left = Counter(r.doc_id for r in found.collect())
    assert left[None] == 2 and not any(left[k] for k in (5000, 5002, 5004)) and left[5001] == left[5003] == 1
    for d, t in rows[:480]:
        x = t.split()
        sets[d] = {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    by = {0.9: [0, 0], 0.8: [0, 0]}
    for k in range(120):
        assert left[10 * k] == 1
        for m in range(1, 4):
            s = len(sets[10 * k] & sets[10 * k + m]) / len(sets[10 * k] | sets[10 * k + m])
            if s < 0.8:
                near = any(len(sets[10 * k + m] & sets[10 * k + o]) >= 0.8 * len(sets[10 * k + m] | sets[10 * k + o]) for o in range(4) if o != m)
                assert left[10 * k + m] == 1 or near
            else:
                by[0.9 if s >= 0.9 else 0.8][0] += 1
                by[0.9 if s >= 0.9 else 0.8][1] += not left[10 * k + m]
    print({k: (n, hit / n) for k, (n, hit) in by.items()})
    assert by[0.9][1] >= 0.85 * by[0.9][0] and by[0.8][1] >= 0.4 * by[0.8][0]


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = documents(spark, sf).where("n_chars < 6000").cache()
    kept = p.quality(spark, docs, sf).cache()
    assert kept.columns == docs.columns
    for d, t in pairs(kept):
        m = brute.measures(t)
        assert m[0] >= 50 and 2 * m[4] <= m[0]
    lines = p.lines(spark, kept, sf).cache()
    gone = brute.removed_lines(pairs(kept))
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ())) for d, t in pairs(kept)}
    assert dict(pairs(lines)) == want and not lines.where("n_chars <> length(text)").count()
    single = p.near_copies(spark, lines, sf).cache()
    ids = {r.doc_id for r in single.collect()}
    assert ids <= {d for d, _ in pairs(lines)}
    assert len({" ".join(t.lower().split()) for _, t in pairs(single)}) == single.count()
    mix = p.mixture(spark, single, sf).cache()
    assert set(mix.select("doc_id", "text").collect()) <= set(single.select("doc_id", "text").collect()) and mix.columns == docs.columns
    packed = p.sequences(spark, mix, sf)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(x) // 4 + 1 for x in word_ids(vocabulary()).texts([t and t.encode() for _, t in pairs(mix)]))
    assert [n for n, _ in p.STAGES] == ["quality rules", "line dedup", "simhash", "mixing", "packing"]


def test_pipeline_run(spark, tmp_path):
    """run() over whole texts, a long one included, against the plain version of its stages; labels too few for cutoffs."""
    import corpus_pipeline as p

    random.seed(21)
    pool = [f"w{k}x" for k in range(3000)]
    some = lambda n: [random.choice(pool) for _ in range(n)]
    wrap = lambda words, n: "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))
    base = some(300)
    texts = [wrap(base, 12), *(wrap(some(random.randint(60, 200)), 12) for _ in range(59)), wrap(some(9000), 12), wrap(some(20), 12), None, "", "ab cd ef " * 60]
    texts += [wrap(base, 12).upper(), wrap(base, 7), wrap([*base[:150], "other", *base[151:]], 5), texts[1] + "\n" + texts[2]]
    sources = dict(enumerate(["a", "b", None, "c"][k % 4] for k in range(len(texts))))
    rows = [(d, t, "en", sources[d], len(t or "")) for d, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    kept = []
    for d, t in enumerate(texts):
        m = brute.measures(t)
        if m[0] >= 50 and 2 * m[4] <= m[0]:
            kept.append((d, t))
    gone = brute.removed_lines(kept)
    kept = brute.without_near_copies([(d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ()))) for d, t in kept])
    assert {0, 1, 2, 60} <= set(kept) and not {61, 62, 63, 64, 66, 67} & set(kept)
    size = {d: len(brute.WORDS(t)) for d, t in kept.items()}
    total, taken = Counter(), Counter()
    for d, n in size.items():
        total[sources[d]] += n
    goals = brute.targets(total)

    found = p.run(spark, str(tmp_path)).collect()
    copies = Counter(r.doc_id for r in found if r.piece == 0)
    want = Counter()
    for d, ids in zip(kept, word_ids(vocabulary()).texts([t.encode() for t in kept.values()]), strict=True):
        ids += b"\0\0\0\0"
        for k, a in enumerate(range(0, len(ids), 8192)):
            part = ids[a : a + 8192]
            want[d, k, a // 4, len(part) // 4, zlib.crc32(part)] += copies[d]
        whole = int(goals[sources[d]] / total[sources[d]] + 1e-9)
        assert copies[d] in (whole, whole + 1)
        taken[sources[d]] += copies[d] * size[d]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == +want
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= max(n for d, n in size.items() if sources[d] == s)
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) * 1.02 + 2


def test_line_dedup_tells_words_of_one_number_apart(spark):
    """Words that share the 40 bits which order them are different words still, in lines of their own and within one line."""
    rows = [(1, "yjctedulhi"), (2, "pubjitqxwz"), (3, "yjctedulhi pubjitqxwz yjctedulhi pubjitqxwz"), (4, "pubjitqxwz yjctedulhi"), (5, "yjctedulhi yjctedulhi")]
    found = line_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.lines for r in found.collect()} == brute.removed_lines(rows) == {4: [0], 5: [0]}
