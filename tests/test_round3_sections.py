"""Search by section: lists of common words are neither made nor shuffled, and its rows are those of a plain search."""

from __future__ import annotations

import random
import re

from quillon.operators import phrases

SECTIONS = "article int, section int, norm string, titles string"
ASKED = "question int, words array<string>, phrase string"
STRENGTH = "question int, article int, level string"


def plain(asked, sections, strength, k=5):
    level = {(q, a): x for q, a, x in strength}
    out = []
    for q, words, phrase in asked:
        best = {}
        for a, s in sorted({(a, s) for a, s, _, _ in sections}):
            own = [(norm, titles) for *at, norm, titles in sections if at == [a, s]]
            body, head = ([t for x in own for t in re.findall(r"[^\W_]+", x[c] or "")] for c in (0, 1))
            hits = [min(10, sum(bool(w) and t.startswith(w) for t in body)) for w in words or []]
            titled = [any(bool(w) and t.startswith(w) for t in head) for w in words or []]
            if level.get((q, a)) == "complete" or words and all(h or t for h, t in zip(hits, titled, strict=True)):
                score = {"complete": 1000, "moderate": 3}.get(level.get((q, a)), 0) + sum(h or t for h, t in zip(hits, titled, strict=True)) + 5 * sum(titled)
                score += 15 if phrase is not None and any(phrase in (norm or "") for norm, _ in own) else 0
                best[a] = max(best.get(a, (-1, 0)), (score, -s))
        top = sorted((-score, a, -s) for a, (score, s) in best.items())[:k]
        out += [(q, a, -score, s, rank) for rank, (score, a, s) in enumerate(top, 1)]
    return sorted(out)


def test_section_search_against_plain(spark):
    random.seed(11)
    words = ["eau", "eaux", "feu", "feux", "sol", "soleil", "été", "112", "a", "de"]
    line = lambda n: " ".join(random.choices(words, [1, 1, 2, 1, 3, 1, 1, 1, 30, 60], k=random.randint(0, n)))
    sections = [(a, s, line(30) if (a + s) % 17 else None, line(4) if a % 13 else None) for a in range(60) for s in range(random.randint(1, 4))]
    sections += [(90, 0, "-".join(["soleil"] * 14), "l'eau"), (91, 0, "le feu de sol", "x"), (92, 0, "", "")]
    sections += [(93, 0, "l'eau de a", "feu"), (93, 0, "sol " * 8, "eau"), (93, 0, "sol " * 8, None)]  # one section in three rows
    asked = [(q, random.sample([*words, "so", "fe"], random.randint(1, 4)), random.choice([None, "a de", "de a"])) for q in range(40)]
    asked += [(50, ["sol", "eau"], "x"), (51, ["absent", "de"], "absent de"), (52, ["", "de"], None), (53, [], None), (54, None, None), (55, [None, "de"], None)]
    strength = [(q, a, random.choice(["complete", "moderate"])) for q in [*range(0, 40, 3), 51, 53, 54] for a in random.sample(range(60), 3)] + [(1, 92, "complete"), (52, 1, "moderate"), (2, 777, "complete")]
    found = phrases.section_search(spark.createDataFrame(asked, ASKED), spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(strength, STRENGTH))
    want = plain([(q, w if w is None or None not in w else [x or "" for x in w], p) for q, w, p in asked], sections, strength)
    assert sorted((r.question, r.article, r.score, r.section, r["rank"]) for r in found.collect()) == want and len(want) > 100


def test_lists_of_common_words_are_not_shuffled(spark):
    sections = spark.createDataFrame([(a, 0, "de la mer" + " rare" * (a == 7), "de") for a in range(300)], SECTIONS)
    found = phrases.section_search(spark.createDataFrame([(1, ["de", "mer", "rare"], None)], ASKED), sections, spark.createDataFrame([], STRENGTH))
    assert [tuple(r) for r in found.collect()] == [(1, 7, 8, 0, 1)]
    told = found._jdf.queryExecution().executedPlan().toString()
    told = told[told.index("Final Plan") : told.index("Initial Plan")]
    # words and the sections that hold them are not dealt out; texts meet those with the rarest word once
    assert not re.search(r"hashpartitioning\((word|term)#", told)
    assert len(re.findall(r"Exchange hashpartitioning\(article#\d+, section#\d+, ", told)) <= 2


def test_beginnings_keep_the_terms_columns(spark):
    words, terms = spark.createDataFrame([("so",), ("sol",), ("so",), ("",)], "w string"), spark.createDataFrame([("sol", 3), ("soleil", 2), ("s", 1)], "t string, n int")
    assert sorted(map(tuple, phrases.starting(words, "w", terms, "t").collect())) == [("so", "sol", 3), ("so", "soleil", 2), ("sol", "sol", 3), ("sol", "soleil", 2)]
    assert phrases.starting(words.limit(0), "w", terms, "t").count() == 0
