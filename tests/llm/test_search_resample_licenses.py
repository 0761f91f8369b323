"""Ranked search, importance resampling and the licence scan against plain versions on planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import lexical_search, license_scan, resampling
from quillon.llm.terms import ranked
from quillon.session import ship

SCHEMA = "doc_id long, text string, rank string, key string, bucket string"
WORD = re.compile("[0-9a-z\\x80-\U0010ffff]+").findall


def words(text):
    return WORD(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def planted():
    random.seed(11)
    pool = ["".join(random.choice("abcdefg") for _ in range(random.randint(1, 4))) for _ in range(120)] + ["É", "été", "中文", "7x", "Z9"]
    text = lambda n: random.choice([" ", ", ", "_", "\n"]).join(random.choice(pool) for _ in range(n))
    rows = [(k, text(random.randint(1, 60))) for k in range(150)] + [(k, "the same text of every copy " * 5) for k in range(150, 230)]
    rows += [(300, None), (301, ""), (302, " \t!?"), (303, text(30_000)), (None, text(40)), (None, None), (5, text(30)), (5, text(30)), (5, "ab ab ab"), (304, "x" * 200_000), (305, "Éa É")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame([(d, t, "r", "k", "b") for d, t in planted()], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    random.seed(12)
    texts = [" ".join(random.sample(words(planted()[k][1]), 1) * 2 + words(planted()[k][1])[:9]) for k in range(40)] + [None, "", "nowhere_else", "the same text of every copy"]
    return spark.createDataFrame([(k if k else None, t, 1) for k, t in enumerate(texts)] + [(7, "the copy ab", 1)], "item_id long, text string, score int")


def plain_search(docs, items, k):
    rows = [(d, Counter(words(t))) for d, t in docs]
    N, L = sum(1 for _, c in rows if c), sum(c.total() for _, c in rows)
    df = Counter(w for _, c in rows for w in c)
    weight = {w: math.floor(1000 * math.log((2 * N + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item, text in items:
        found = []
        for d, c in rows:
            m = 50 + (50 * c.total() * N) // max(1, L)
            score = sum(weight[w] * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(words(text)) if w in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, n + 1, None if null else d, -s) for n, (s, null, d) in enumerate(sorted(found)[:k])]
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, docs, items, monkeypatch, small):
    if small:  # many blocks on both sides, candidates that overflow, no broadcast
        for name, value in (("POSTINGS", 40), ("PLACES", 30), ("BROADCAST", 0), ("HELD", 100)):
            monkeypatch.setattr(lexical_search, name, value)
    asked = [(r.item_id, r.text) for r in items.collect()]
    for k in (50, 3):
        found = lexical_search.search(docs, items, k)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, found.collect())) == plain_search(planted(), asked, k)


def test_search_of_nothing(docs, items):
    assert lexical_search.search(docs.limit(0), items).count() == 0 == lexical_search.search(docs, items.limit(0)).count()
    twice = {(r.item_id, r.doc_id): r.score for r in lexical_search.search(docs, items, 1000, repeats=True).where("item_id = 43").collect()}
    once = {(r.item_id, r.doc_id): r.score for r in lexical_search.search(docs, items, 1000).where("item_id = 43").collect()}
    assert twice == once  # no term of this item repeats


def plain_resampling(docs, target, least=20, percent=5):
    grams = lambda text: [" ".join(w[i : i + k]) for w in [words(text)] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    rows = [(d, len(words(t)), Counter(map(bucket, grams(t)))) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, c in rows:
        s.update(c)
    for x in target:
        t.update(map(bucket, grams(x)))
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    out = []
    for d, n, c in rows:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * m for b, m in c.items())
        out.append((d, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = percent * sum(x[1] >= least for x in out) // 100
    order = sorted(range(len(out)), key=lambda j: (out[j][1] < least, -out[j][4], out[j][0] is None, out[j][0] or 0, -out[j][3], -out[j][2]))
    rank = {j: k + 1 for k, j in enumerate(order[:drawn])}
    return Counter((*x, rank.get(j)) for j, x in enumerate(out))


def test_resampling(spark, docs, items):
    target = [r.text for r in items.collect()]
    for percent in (5, 60):
        found = resampling.importance(docs, items, percent=percent)
        assert Counter(map(tuple, found.collect())) == plain_resampling(planted(), target, percent=percent)
    kept = resampling.drawn(docs, found)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found.where("rank is not null").collect()}
    assert resampling.importance(docs.limit(0), items).count() == 0
    assert Counter(map(tuple, resampling.importance(docs, items.limit(0)).collect())) == plain_resampling(planted(), [])


def test_ranked_over_ranges(spark):
    rows = [(k % 7, k) for k in range(1000)]
    found = ranked(spark.createDataFrame(rows, "a long, _at long").repartition(5), F.desc("a"), F.col("_at"))
    assert [(r["a"], r["_at"]) for r in found.orderBy("rank").collect()] == sorted(rows, key=lambda x: (-x[0], x[1])) and found.columns == ["a", "_at", "rank"]
    assert ranked(spark.createDataFrame([], "a long"), F.col("a")).count() == 0


def licensed():
    random.seed(13)
    noise = lambda n: " ".join(random.choice(["the", "license", "version", "public", "mit", "2", "cc", "by", "general", "gnu", "x", "under"]) for _ in range(n))
    rows = [(k, noise(random.randint(0, 200))) for k in range(120)]
    rows += [(200, "Released under the MIT License."), (201, "Licensed under the Apache License, Version 2.0."), (202, "CC BY-NC 4.0, cc-by_nc; CC BY" + " NC" * 3), (203, None), (204, ""), (205, "under the mit\nlicense " * 3000)]
    rows += [(206 + k, f"{noise(9)} {t.text} {noise(9)}") for k, t in enumerate(license_scan.OWN)]
    far = license_scan.OWN[0].text.replace("to any person", "to " + "some " * 7 + "person").replace("and associated", "and " + "more " * 40)
    rows += [(300, far), (301, "GNU General Public License, version" + " of it" * 12 + " 3"), (302, "version 3 gnu general public license"), (303, "gnu general public license, in its version 3"), (303, "all rights reserved"), (303, "all rights reserved"), (None, "under the mit license"), (304, "a b " * 30_000 + "cc by nc"), (305, "UNDER THE MIT LICENSÉ, under the mıt license")]
    return rows


def plain_scan(rows):
    templates = [*license_scan.BASE, *license_scan.OWN]
    texts = [words(t) for _, t in rows]
    sets, vocabulary = [set(w) for w in texts], license_scan.vocabulary(templates)
    idf = {v: math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * sum(v in s for s in sets) + 1))) for v in vocabulary}
    out, slack = [], license_scan.SLACK
    for (d, _), w in zip(rows, texts, strict=True):
        places, base, labels, score = set(), set(), set(), 0.0
        for t, x in enumerate(templates):
            near = defaultdict(set)
            for k, (phrase, start) in enumerate(zip(x.phrases, x.starts(), strict=True)):
                own = phrase.split()
                for i in [i for i, v in enumerate(w) if v == own[0] and w[i : i + len(own)] == own]:
                    if x.base:
                        places.add((t, i))
                    for shift in (0, 1):
                        near[shift, (i - start + shift * (slack + 1)) // (2 * slack + 2)].add(k)
            total = sum(idf[v] for p in x.phrases for v in p.split())
            for ks in near.values():
                score = max(score, 1.0 if len(ks) == len(x.phrases) else sum(idf[v] for k in ks for v in x.phrases[k].split()) / total)
                if len(ks) == len(x.phrases):
                    labels.add(x.label)
                    base |= {x.label} if x.base else set()
        at = sorted(i for _, i in places)
        out.append((d, len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)))
    return Counter(out)


def test_licences(spark):
    rows = licensed()
    df = spark.createDataFrame([(d, t, "l", 1) for d, t in rows], "doc_id long, text string, labels string, template int")
    found = license_scan.scan(df)
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    mine = Counter((*tuple(r)[:-1], round(r.score, 9)) for r in found.collect())
    assert mine == plain_scan(rows)
    by = {r.doc_id: r for r in found.collect() if r.doc_id is not None and r.doc_id != 303}
    assert by[205].n_base == 3000 and by[205].last_word == 4 * 2999 and by[202].n_base == 3 and by[201].base_labels == "apache-2"
    assert all(x.label in by[206 + k].labels.split(",") for k, x in enumerate(license_scan.OWN))
    assert by[301].labels == "" and by[302].labels == "gpl-3" and 0 < by[301].score < 1 and by[305].n_base == 0
    assert license_scan.scan(df.limit(0)).count() == 0
    assert license_scan.scan(df, own=()).where("labels <> base_labels").count() == 0


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_resampling", "op13_license_scan"])
def test_twins(spark, sf, name):
    from quillon.llm import registry
    from tests.oracle import check

    assert check(spark, registry.queries()[name], sf, registry.oracle_sql()[name]) > 0
