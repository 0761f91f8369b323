"""Question preparation, signs of danger, terms and glossaries against plain versions written from the rules."""

from __future__ import annotations

import random
import re
import unicodedata

from pyspark.sql import functions as F

from quillon.functions import lexicon as lx
from quillon.functions import rules
from quillon.operators import questions

TABLE = [
    (0, ["j'ai du mal à respirer", "essoufflé"], ["dyspnée", "détresse respiratoire"], ["asthme"], "souffle"),
    (1, ["mordu par un chien", "morsure"], ["morsure de chien"], ["rage", "dyspnée"], "animaux"),
    (2, ["morsure de serpent"], ["envenimation"], [], "animaux"),
    (3, ["la courante", "diarrhées"], ["diarrhée"], None, "ventre"),
    (4, ["coupure de courant"], ["panne électrique", " "], ["groupe électrogène"], "courant"),
    (5, ["un le", "rien"], [], ["x"], "vide"),
    (6, None, ["y"], [], "vide"),
]
ASKED = ["Le chien m'a mordu !", "morsure de serpent, que faire", "j'ai la courante", "Une coupure de courant", "Mal à respirer, et une morsure de serpent en forêt profonde", "bonjour", "", None, "Les diarrhées", "le serpent rouge longue Longue LONGUEUR"]


def plain(text):
    bare = "".join(c for c in unicodedata.normalize("NFD", text.replace("œ", "oe").lower()) if unicodedata.category(c)[0] != "M")
    return re.findall(r"[^\W_]+", bare)


def prepare(text):
    text = text or ""
    stem = lambda w: re.sub("(es|s|e|x)$", "", w)
    found = []
    for entry, said, search, also, theme in TABLE:
        search = [x for x in search if x.strip()]
        for nth, s in enumerate(said or []):
            stems = list(dict.fromkeys(stem(w) for w in plain(s) if w not in questions.SMALL))
            if not search or not stems:
                continue
            inside = set(stems) <= {stem(w) for w in plain(text)}
            if len(plain(s)) > 1 and len(stems) == 1:
                inside = inside and f" {' '.join(plain(s))} " in f" {' '.join(plain(text))} "
            if inside:
                found.append((-len(stems), -len(" ".join(stems)), entry, nth, stems, search, also or [], theme))
    taken, kept = set(), []
    for x in sorted(found):
        if set(x[4]) <= taken:
            continue
        taken |= set(x[4])
        if x[2] not in [k[2] for k in kept]:
            kept.append(x)
    search = list(dict.fromkeys(t for k in kept for t in k[5]))
    also = [t for t in dict.fromkeys(t for k in kept for t in k[6]) if t not in search]
    useful = lambda t: [w for w in plain(t) if len(w) >= 3 and w not in lx.EMPTY]
    covered = {w for t in search for w in useful(t)}
    single = [w for w in dict.fromkeys(re.findall(r"[^\W_]+", text)) if len(w) >= 4 and "".join(plain(w)) in useful(text) and "".join(plain(w)) not in covered]
    single.sort(key=len, reverse=True)
    return (search[:1] or [None])[0], search, also, list(dict.fromkeys(k[7] for k in kept)), [text, *search[:3], *single][:6], f"{text} ({', '.join(search)})" if search else text


def test_prepared(spark):
    table = questions.patterns(spark.createDataFrame(TABLE, "entry int, said array<string>, search array<string>, also array<string>, theme string"))
    rows = spark.createDataFrame(list(enumerate(ASKED)), "question int, text string")
    found = questions.prepared(questions.understood(rows, "question", "text", table), "text").collect()
    mine = {r.question: (r.term, r.search, r.also, r.themes, r.searches, r.vector_text) for r in found}
    assert mine == {k: prepare(t) for k, t in enumerate(ASKED)}
    assert mine[0][1] == ["morsure de chien"] and mine[2][1] == ["diarrhée"] and mine[3][1] == ["panne électrique"] and mine[1][1] == ["envenimation"]
    assert questions.understood(rows.limit(0), "question", "text", table).count() == 0
    assert {r.term for r in questions.understood(rows, "question", "text", table.limit(0)).collect()} == {None}


def test_all_words(spark):
    many = [" ".join(f"mot{k}{j}" for j in range(5)) for k in range(4)]
    rows = spark.createDataFrame([(["l'eau de mer", "mer rouge"],), (many,), ([],)], "s array<string>")
    found = [r[0] for r in rows.select(questions.all_words(F.col("s"))).collect()]
    assert found == [["eau", "mer", "rouge"], [w for m in many for w in m.split()][:16], []]


def test_serious(spark):
    cases = [
        ("Il a perdu connaissance", False, True), ("J’ai une douleur dans la poitrine", False, True), ("douleur " + "x" * 40 + " poitrine", False, False),
        ("il s'étrangle", None, True), ("brûlure au visage", False, True), ("petite brûlure", True, False), ("petite brûlure étendue", False, True),
        ("elle a avalé de l'eau de javel", False, True), ("tombé du toit", False, True), ("je suis tombée, mal au dos", False, True),
        ("il ne sent plus ses jambes", False, True), ("comment cuire des pâtes", True, True), ("comment cuire des pâtes", False, False),
        ("une ampoule au pied", True, False), ("", False, False), ("", True, True), (None, True, False), ("fracture ouverte", None, True),
    ]
    rows = spark.createDataFrame([(k, t, f) for k, (t, f, _) in enumerate(cases)], "k int, t string, f boolean")
    found = {r.k: r.s for r in rows.select("k", rules.serious(F.col("t"), F.col("f")).alias("s")).collect()}
    assert {k: (cases[k][0], v) for k, v in found.items()} == {k: (t, s) for k, (t, _, s) in enumerate(cases)}


def test_terms_and_glossaries(spark):
    cases = [("fièvre jaune", "la fièvre jaune est-elle grave", "fièvre jaune"), (" Fièvre ", "fievres fortes", "Fièvre"), ("eau", "la fièvre", None), ("le", "le feu", None), ("3 eaux", "3 eaux", None), (None, "eau", None), ("eau", None, None), ("a" * 41, "a" * 41, None)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    found = {r.k: r.t for r in rows.select("k", rules.term_of_question(F.col("a"), lx.useful_words(F.col("a")), lx.useful_words(F.col("b"))).alias("t")).collect()}
    assert found == {k: t for k, (_, _, t) in enumerate(cases)}
    entry = "Délire, m état. "
    texts = spark.createDataFrame([(0, entry * 6), (1, entry * 5 + "Coma, mer"), (2, None), (3, entry * 5 + "Aïe, adv é")], "k int, t string")
    assert {r.k: r.g for r in texts.select("k", rules.glossary(F.col("t")).alias("g")).collect()} == {0: True, 1: False, 2: False, 3: True}
