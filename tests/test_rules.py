"""Rules on small cases: messages, danger, titles, positions, the greedy cover."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import rules
from quillon.functions import text as tx
from quillon.operators.retrieval import greedy_cover


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


@pytest.mark.parametrize(("text", "category"), [("Bonjour !", "salutation"), ("Merci beaucoup", "remerciement"), ("Ça va ?", "salutation"), ("D'accord, merci", "remerciement"), ("Qui es-tu ?", "soi"), ("au revoir", "aurevoir"), ("ok", "acquiescement"), ("comment faire du feu", None), ("", None), (None, None)])
def test_small_talk(spark, text, category):
    assert one(spark, text, rules.small_talk) == category


@pytest.mark.parametrize(("text", "danger"), [("il a avalé de l'eau de javel", True), ("tombée du toit", True), ("elle ne sent plus ses jambes", True), ("le toit fuit", False), ("tombe la pluie", False), ("", False)])
def test_danger(spark, text, danger):
    assert one(spark, text, lambda c: rules.in_danger(tx.tokens(tx.normalize(c)))) is danger


@pytest.mark.parametrize(("title", "relation"), [("Fièvre", "exact"), ("fievre jaune", "commence"), ("fièvre jaune grave", "specialise"), ("La fièvre", "specialise"), ("eau", "aucun"), ("", "aucun"), (None, "aucun")])
def test_title_relation(spark, title, relation):
    assert one(spark, title, lambda c: rules.title_relation(c, "fievre")) == relation


@pytest.mark.parametrize(("text", "at"), [("bœuf", [0, 1, 1, 2, 3]), ("", []), ("é", [0])])
def test_positions(spark, text, at):
    assert one(spark, text, rules.positions) == at


def test_same_word(spark):
    pairs = [("fievre", "fievres", True), ("purifier", "purification", True), ("eau", "eaux", False), ("sel", "sel", True), ("main", "maintenant", True), ("porte", "portail", True), ("feu", "fleuve", False)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(rules.same_word(F.col("a"), F.col("b")))
    assert [r[0] for r in df.collect()] == [p[2] for p in pairs]


def test_greedy_cover(spark):
    draw = random.Random(3)
    items = {(q, i): sorted(draw.sample(range(9), draw.randint(1, 3))) for q in range(40) for i in range(draw.randint(0, 8))}
    want, covered = set(), {}
    for q, i in sorted(items):
        own = covered.setdefault(q, set())
        if not own.issuperset(items[q, i]):
            want.add((q, i))
            own.update(items[q, i])
    found = spark.createDataFrame([(q, i, w) for (q, i), ws in items.items() for w in ws], "q int, item int, word int")
    assert {tuple(r) for r in greedy_cover(found, ["q"], "item", "word").collect()} == want


def test_first_rule_takes_no_part_of_a_long_table(spark):
    from quillon.operators.tables import first_rule

    rows = spark.createDataFrame([("a",)], "_host string")
    with pytest.raises(ValueError, match="1000 rules"):
        first_rule(rows, spark.range(1001).selectExpr("id as ordinal", "'a' as host", "1 as answer"), ["host"])
    assert first_rule(rows, spark.range(3).selectExpr("id as ordinal", "'a' as host", "cast(id + 5 as int) as answer"), ["host"]).first().answer == 5


def test_hits_takes_words_literally(spark):
    df = spark.createDataFrame([("c++ and c, c+ (x) a.b aab",)], "t string")
    found = df.select(*[tx.hits(F.col("t"), w).alias(f"h{k}") for k, w in enumerate(["c++", "c", "(x", "a.b", "an d"])]).first()
    assert tuple(found) == (1, 3, 1, 1, 0)


def test_normalize_takes_all_marks_off(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from quillon.functions import rules
    from quillon.functions import text as tx

    texts = ["Ẽté ẬB éa Ύψ Ἀθ", "a b　c﻿d e\x0bf", "ŒUVRE œ’‘ ß", "각 한국", "ЙЁ й", "", None, "x̧́y"]

    def plain(s):
        out = ""
        for c in s:
            if c in tx.LIGATURES:
                out += tx.LIGATURES[c]
            elif c in tx.APOSTROPHES:
                out += "'"
            elif c.isspace() or c == "﻿":
                out += " "
            else:
                bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M").lower()
                out += bare if len(bare) < 2 else c
        return out

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", tx.normalize(F.col("t")).alias("n"), rules.positions(F.col("t")).alias("at"))
    for r in df.collect():
        assert r.n == (None if texts[r.k] is None else plain(texts[r.k])), (texts[r.k], r.n)
        assert r.n is None or len(r["at"]) == len(r.n)


def test_first_rule_takes_marks_literally(spark):
    from quillon.operators.tables import first_rule, in_network
    from pyspark.sql import functions as F

    rules_ = spark.createDataFrame([(0, "[[]", 1), (1, "a^b", 2), (2, "c\\E.*", 3), (3, "x*y*", 4), (4, "$(1)", 5), (5, "*", 6)], "ordinal int, host string, answer int")
    rows = spark.createDataFrame([("[[]",), ("a^b",), ("c\\E.d",), ("c\\Exd",), ("xzyz",), ("x\ny",), ("$(1)",), ("",)], "_host string")
    found = {r._host: r.answer for r in first_rule(rows, rules_, ["host"]).collect()}
    assert found == {"[[]": 1, "a^b": 2, "c\\E.d": 3, "c\\Exd": 6, "xzyz": 4, "x\ny": 4, "$(1)": 5, "": 6}
    ips = spark.createDataFrame([("10.0.0.5",), ("999.1.1.1",), ("10.0.0",), ("10.0.0.6",), ("10.0.0.5.",), (None,)], "ip string")
    assert [r[0] for r in ips.select(in_network(F.col("ip"), "10.0.0.5")).collect()] == [True, None, None, False, None, None]
    assert [r[0] for r in ips.select(in_network(F.col("ip"), "0.0.0.0/0")).collect()][:2] == [True, None]
