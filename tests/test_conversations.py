"""The store of conversations, entries of catalogues, manifests and settings against the rules, case by case."""

from __future__ import annotations

import copy
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import checks
from quillon.operators import conversations as cv
from quillon.operators import manifests
from quillon.operators.snapshots import Change, Store

EXCHANGE = "request long, conversation long, question string, answer string, sources array<string>, outcome int, asked timestamp, answered timestamp"
at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


def exchange(n, conversation, question, answer="oui", sources=("livre",), outcome=1):
    return (n, conversation, question, answer, None if sources is None else list(sources), outcome, at(n), at(n + 1))


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/c")
    put = lambda *rows: {r.request: r.conversation for r in cv.add(store, spark.createDataFrame(list(rows), EXCHANGE)).collect()}
    listed = lambda **how: [(r.id, r.title) for r in cv.conversations(store.snapshot(), **how).collect()]
    made = put(exchange(2, None, "Que  faire \n en cas de " + "x" * 60), exchange(1, 77, " \t "), exchange(3, None, None, sources=None), exchange(4, None, "sans réponse", None))
    assert made == {1: 1, 2: 2, 3: 3}
    assert listed() == [(3, "Sans titre"), (2, ("Que faire en cas de " + "x" * 60)[:50]), (1, "Sans titre")] and listed(most=1) == [(3, "Sans titre")]
    before = store.snapshot()
    assert put(exchange(5, 1, "encore"), exchange(6, 99, "autre"), exchange(7, 1, "et puis")) == {5: 1, 6: 4, 7: 1}
    assert [i for i, _ in listed()] == [1, 4, 3, 2] and cv.present(before).count() == 3
    one = cv.messages(store.snapshot()).where("conversation = 1").orderBy("at", F.desc("kind")).collect()
    assert [(r.kind, r.text) for r in one] == [("question", " \t "), ("answer", "oui"), ("question", "encore"), ("answer", "oui"), ("question", "et puis"), ("answer", "oui")]
    assert one[0].sources is None and one[1].sources == ["livre"] and one[1].outcome == 1
    refused = cv.rename(store, spark.createDataFrame([(1, "  Un \n titre "), (2, " "), (55, "rien"), (3, "y" * 120), (4, None)], "id int, title string"))
    assert sorted(r.id for r in refused.collect()) == [2, 4]
    assert dict(listed())[1] == "Un titre" and dict(listed())[3] == "y" * 100 and [i for i, _ in listed()] == [1, 4, 3, 2]
    cv.delete(store, spark.createDataFrame([(4,), (4,), (55,), (None,)], "id int"))
    assert [i for i, _ in listed()] == [1, 3, 2] and cv.messages(store.snapshot()).where("conversation = 4").count() == 0
    assert put(exchange(9, 4, "encore là ?")) == {9: 5}
    state = sorted(listed()), cv.messages(store.snapshot()).count()
    cv.compact(store)
    assert (sorted(listed()), cv.messages(store.snapshot()).count()) == state and store.snapshot().table("messages").count() == state[1]
    cv.clear(store)
    assert listed() == [] and cv.messages(store.snapshot()).count() == 0
    assert put(exchange(10, 1, "nouveau")) == {10: 6} and cv.add(store, spark.createDataFrame([], EXCHANGE)).count() == 0


def test_both_tables_or_none(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/c")
    cv.add(store, spark.createDataFrame([exchange(1, None, "un")], EXCHANGE))
    append = Change.append
    monkeypatch.setattr(Change, "append", lambda self, name, df, by=None: (_ for _ in ()).throw(OSError("no disk")) if name == "messages" else append(self, name, df, by))
    with pytest.raises(OSError):
        cv.add(store, spark.createDataFrame([exchange(2, 1, "deux")], EXCHANGE))
    assert store.snapshot().version == 1 and cv.messages(store.snapshot()).count() == 2
    assert cv.conversations(store.snapshot()).first().changed == at(1)


def test_numbers_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    found = [(r.g, r.k, r.number) for r in cv.numbered(rows, "g", "k").collect()]
    assert [n for _, _, n in sorted(found)] == list(range(1000))
    assert cv.numbered(rows.limit(0), "g", "k").count() == 0


BOOK = {"id": "guide-1", "type": "pdf", "titre": "t", "editeur": "e", "langue": "fr", "categorie": "c", "attribution": "a", "auteurs": ["x"], "licence": {"nom": "CC", "url": "https://x.org"}, "sources": ["https://x.org/a"], "sha256": "a" * 64, "taille": 5}


def test_book_reasons(spark):
    cases = [({}, None), ({"taille": 5.0}, None)]
    for change, reason in [({"id": 5}, "id"), ({"id": "A"}, "id"), ({"type": "epub"}, "type"), ({"titre": " "}, "titre"), ({"attribution": 3}, "attribution"), ({"auteurs": []}, "auteurs"), ({"auteurs": ["x", ""]}, "auteurs"), ({"auteurs": "x"}, "auteurs"), ({"licence": None}, "licence"), ({"licence": {"nom": "CC", "url": "http://x"}}, "licence"), ({"sources": ["https://a b"]}, "sources"), ({"sources": [None]}, "sources"), ({"sha256": "A" * 64}, "sha256"), ({"taille": 0}, "taille"), ({"taille": 1.5}, "taille"), ({"taille": "5"}, "taille"), ({"id": "", "taille": 0}, "id")]:
        cases.append((change, reason))
    rows = [(k, json.dumps(copy.deepcopy(BOOK) | c)) for k, (c, _) in enumerate(cases)] + [(100, "[]"), (101, "5"), (102, "no json"), (103, None), (104, "null")]
    found = {r.k: r.r for r in spark.createDataFrame(rows, "k int, t string").select("k", checks.book_reason(F.try_parse_json("t")).alias("r")).collect()}
    assert found == {k: r for k, (_, r) in enumerate(cases)} | {k: "entry" for k in range(100, 105)}


def test_language_and_model_reasons(spark):
    file = {"url": "https://x/a", "sha256": "0" * 64, "taille": 0}
    good = {"code": "pt-br", "nom": "", "decoupage": "fr", "modeles": [file]}
    cases = [({}, None), ({"modeles": []}, None), ({"code": "PT"}, "code"), ({"nom": 1}, "nom"), ({"decoupage": "xx"}, "decoupage"), ({"decoupage": None}, "decoupage"), ({"modeles": [file, file | {"url": "http://x"}]}, "modeles"), ({"modeles": None}, "modeles"), ({"modeles": [file | {"taille": 1.5}]}, "modeles")]
    rows = spark.createDataFrame([(k, json.dumps(good | c)) for k, (c, _) in enumerate(cases)], "k int, t string")
    found = {r.k: r.r for r in rows.select("k", checks.language_reason(F.try_parse_json("t"), F.array(F.lit("fr"), F.lit("en"))).alias("r")).collect()}
    assert found == {k: r for k, (_, r) in enumerate(cases)}
    model = {"id": "a", "tag": "b", "taille": 1, "vram_min_mo": 0}
    cases = [({}, None), ({"id": ""}, "id"), ({"tag": None}, "tag"), ({"taille": 0}, "taille"), ({"vram_min_mo": -1}, "vram_min_mo"), ({"vram_min_mo": None}, "vram_min_mo")]
    rows = spark.createDataFrame([(k, json.dumps(model | c)) for k, (c, _) in enumerate(cases)], "k int, t string")
    assert {r.k: r.r for r in rows.select("k", checks.model_reason(F.try_parse_json("t")).alias("r")).collect()} == {k: r for k, (_, r) in enumerate(cases)}


def test_settings(spark):
    default = {"nom": "Nom", "avatar": "hibou", "couleur": "#112233", "tutoiement": True, "ton": "calme", "longueur": "adaptee"}
    base = ("Nom", "hibou", "#112233", False, True, "calme", "adaptee")
    cases = [
        ("{}", base), ("no json", base), (None, base), ("[]", base),
        ('{"nom":"  Ada ","avatar":"chat","couleur":"#AABBCC","configure":true,"personnalite":{"tutoiement":false,"ton":"vif","longueur":"courte"}}', ("Ada", "chat", "#aabbcc", True, False, "vif", "courte")),
        ('{"nom":5,"avatar":"X","couleur":"red","configure":"true","personnalite":{"tutoiement":"no","ton":" ","longueur":"longue"}}', base),
        (json.dumps({"nom": "n" * 50}), ("n" * 40, *base[1:])),
    ]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    assert {r.k: tuple(r.s) for r in rows.select("k", checks.settings(F.try_parse_json("t"), default).alias("s")).collect()} == {k: v for k, (_, v) in enumerate(cases)}


def test_manifest_faults(spark):
    hash_ = "b" * 64
    head, kind = {"format": 1, "version": "v", "generated_at": "d", "origin": "https://x.org", "sha256": hash_, "size": 5, "url": "https://X.org/a.tar"}, {"pos": 0, "slug": "soins", "title": "t", "description": "", "place": 1.0}
    article = {"pos": 0, "slug": "a", "title": "t", "summary": "", "category": "soins", "published": "2024-01-01", "updated": "2024-01-01T10", "sha256": hash_}
    cases = [
        ({}, [{}], [{}], (None, None)), ({}, [], [], (None, None)), ({"format": 2}, [{"slug": "?"}], [{}], ("format", None)), ({"version": "x" * 101}, [{}], [], ("version", None)), ({"generated_at": None}, [{}], [], ("generated_at", None)),
        ({}, [{}, {"pos": 1, "title": " ", "slug": "b"}], [{"slug": "?"}], ("category", "b")), ({}, [{}, {"pos": 1}], [{}], ("category again", "soins")), ({}, [{"place": float("nan")}], [], ("category", "soins")),
        ({}, [{}], [{"pos": 3, "sha256": "?"}, {"pos": 2, "slug": "z", "category": "eau"}], ("unknown category", "z")), ({}, [{}], [{}, {"pos": 1}], ("article again", "a")), ({}, [{}], [{"slug": "a" * 151}], ("article", "a" * 151)),
        ({}, [{}], [{"title": None}], ("title", "a")), ({}, [{}], [{"updated": "hier"}], ("dates", "a")), ({}, [{}], [{"sha256": None}], ("sha256", "a")), ({}, [{}], [{"slug": None}], ("article", None)),
        ({"size": 0}, [{}], [{}], ("archive", None)), ({"size": 100 * 1024 * 1024 + 1}, [{}], [], ("archive", None)), ({"url": "https://x.org.evil/a"}, [{}], [], ("archive elsewhere", None)), ({"url": "http://x.org/a"}, [{}], [], ("archive elsewhere", None)),
    ]
    rows = lambda base, part, schema: spark.createDataFrame([(k, *(base | c).values()) for k, case in enumerate(cases) for c in part(case)], schema)
    found = manifests.faults(
        rows(head, lambda c: [c[0]], "manifest int, format int, version string, generated_at string, origin string, sha256 string, size long, url string"),
        rows(kind, lambda c: c[1], "manifest int, pos int, slug string, title string, description string, place double"),
        rows(article, lambda c: c[2], "manifest int, pos int, slug string, title string, summary string, category string, published string, updated string, sha256 string"),
    )
    assert {r.manifest: (r.reason, r.item) for r in found.collect()} == {k: c[3] for k, c in enumerate(cases)}
