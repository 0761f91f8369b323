"""Ranking rules and marks against plain versions written from the rules."""

from __future__ import annotations

import html
import math
import random
import re
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from quillon.functions import marks
from quillon.functions import text as tx
from quillon.operators import ranking

WORD = re.compile(r"[^\W_]+").findall
POOL = ["fievre", "jaune", "eau", "brulure", "soins", "premiers", "de", "forte", "que", "faire", "traitement", "fievres", "recurrente", "rouge"]


def test_reranked(spark):
    random.seed(8)
    pick = lambda n: " ".join(random.choice(POOL) for _ in range(n))
    titles = ["Fièvre", "fievre jaune", "fievre jaune des montagnes", "Eau", "la fievre rouge et forte", "", None]
    sections = ["Premiers soins", "traitement de fond", "Histoire", "que faire", None, "brulure"]
    passages = [(q, p, random.choice(titles), random.choice(sections), pick(random.randint(1, 30)), random.choice([None, pick(2)])) for q in range(25) for p in range(random.randint(0, 8))]
    asked = [(q, random.sample(POOL, random.randint(0, 3)), random.choice([None, random.sample(POOL, 2)]), random.choice(["fievre", None, "eau", ""])) for q in range(25)]
    df = spark.createDataFrame(passages, "question int, passage int, title string, section string, text string, keys string")
    found = ranking.reranked(df, spark.createDataFrame(asked, "question int, words array<string>, neighbours array<string>, term string"), 4)
    normal = lambda s: " ".join(unicodedata.normalize("NFD", s or "").encode("ascii", "ignore").decode().lower().split())
    fits = lambda t, m: t == m or (len(m) >= 5 and t.startswith(m))
    want = {}
    for q, words, near, term in asked:
        own = [p for p in passages if p[0] == q]
        every = words + [x for x in dict.fromkeys(near or []) if x not in words]
        if not words or not own:
            continue
        docs = [WORD(normal(" ".join(x or "" for x in p[2:]))) for p in own]
        mean = sum(map(len, docs)) / len(docs)
        kinds = []
        for p in own:
            t = normal(p[2])
            extras = [x for x in t.split() if x not in (term or "").split()]
            kind = "none" if not t or not term else "exact" if t == term else "begins" if t.startswith(term + " ") and len(extras) <= 1 else "special" if term in t else "none"
            kinds.append((kind, extras))
        general = any(k in ("exact", "begins") for k, _ in kinds)
        scores = []
        for p, d, (kind, extras) in zip(own, docs, kinds, strict=True):
            raw = 0.0
            for j, m in enumerate(every):
                df_ = sum(any(fits(t, m) for t in x) for x in docs)
                f = sum(fits(t, m) for t in d)
                raw += (1 if j < len(words) else 0.5) * math.log(1 + (len(docs) - df_ + 0.5) / (df_ + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean))
            head = WORD(normal(p[3]))
            raw *= 1 + 0.5 * sum(any(fits(t, m) for t in head) for m in every)
            score, add = raw, 0.0
            if kind == "exact":
                score, add = score * 3, add + 0.15
            elif kind == "begins":
                score *= 1.8
            elif kind == "special" and general and len(extras) >= 2 and not any(fits(x, m) for x in extras for m in every):
                score, add = score * 2 / 3, add - 0.05
            s = normal(p[3])
            if any(s == g or s.startswith(g + " ") for g in ("premiers soins", "traitement", "que faire", "symptomes", "prevention", "diagnostic")):
                score, add = score * 1.4, add + 0.03
            if score > 0:
                scores.append((-round(score, 9), p[1], round(raw, 6), round(add, 4)))
        for k, (s, p, raw, add) in enumerate(sorted(scores)[:4]):
            want[q, p] = (round(-s, 6), raw, add, k + 1)
    assert {(r.question, r.passage): (round(r.score, 6), round(r.raw, 6), r.adjustment, r["rank"]) for r in found.collect()} == want and len(want) > 40


def test_promoted(spark):
    random.seed(9)
    rows = []
    for q in range(60):
        for p in range(random.randint(1, 6)):
            level = random.choice([None, "complete", "moderate"])
            rows.append((q, p, random.choice("abc"), random.choice([None, round(random.uniform(0.1, 0.7), 3)]), random.choice([None, 0.0, 0.15, -0.05]), level, random.choice([0.25, 0.35]) if level else None))
    found = ranking.promoted(spark.createDataFrame(rows, "question int, passage int, title string, cosine double, adjustment double, level string, floor double"), 0.46)
    want, by = {}, defaultdict(list)
    for r in rows:
        by[r[0]].append(dict(zip(("q", "p", "t", "c", "a", "l", "f"), r, strict=True)))
    for ps in by.values():
        score = lambda x: x["c"] + (x["a"] or 0)
        usable = [x for x in ps if x["c"] is not None]
        full = sorted((x for x in usable if x["l"] == "complete" and x["c"] >= x["f"]), key=lambda x: -x["c"])
        win = full[0] if full else None
        for x in usable:
            if not x["l"] or (win and x["t"] == win["t"]) or x["c"] < (0.35 if x["l"] == "complete" else x["f"]) or score(x) >= 0.46:
                continue
            bonus = min(0.05, 0.46 - 0.001 - score(x))
            if bonus > 0:
                x["a"] = round((x["a"] or 0) + bonus, 4)
        if win:
            goal = max([0.46, *(score(x) + 0.001 for x in usable if x["t"] != win["t"])])
            if score(win) < goal:
                win["a"] = math.ceil((goal - win["c"]) * 1e4 + 1) / 1e4
        want |= {(x["q"], x["p"]): x["a"] for x in ps}
    got = {(r.question, r.passage): r.adjustment for r in found.collect()}
    assert got.keys() == want.keys() and all((a is None) == (want[k] is None) and (a is None or abs(a - want[k]) < 1e-9) for k, a in got.items())


def test_merged_and_for_model(spark):
    kind = "question int, passage int, origin string, word_rank int, cosine double, adjustment double, coverage double, guide boolean, urgent boolean"
    rows = [(1, 1, "documents", 1, 0.2, None, 0.9, False, True), (1, 2, "wiki", None, 0.6, 0.0, 0.1, False, True), (1, 3, "wiki", None, 0.5, 0.15, 0.1, False, True), (1, 4, "guides", None, None, None, 1.0, True, True), (1, 5, "guides", None, 0.4, None, 0.1, True, True), (2, 1, "documents", None, None, None, 0.5, False, False), (2, 2, "wiki", None, None, None, 0.7, False, False)]
    df = spark.createDataFrame(rows, kind)
    place = lambda n: sorted((r.question, r["rank"], r.passage) for r in ranking.merged(df, n).collect())
    assert place(2) == [(1, 1, 3), (1, 2, 1), (2, 1, 2), (2, 2, 1)]
    assert place(9) == [(1, 1, 3), (1, 2, 2), (1, 3, 5), (1, 4, 1), (2, 1, 2), (2, 2, 1)]
    limits = spark.createDataFrame([("documents", 0.4, 0.18), ("wiki", 0.48, 0.42), ("guides", 0.46, 0.35)], "origin string, answer double, close double")
    kept = lambda e: sorted((r.question, r.passage) for r in ranking.for_model(df, limits, e).collect())
    assert kept(None) == [(1, 1), (1, 2), (1, 3)] and kept("urgent") == [(1, 1), (1, 2), (1, 3), (1, 5)]


def test_marks(spark):
    cases = [("Œuvre <b> d'art & œuvres", ["oeuvre", "art"]), ("éléphant Éléphants", ["elephant", "el"]), ("personne sonne", ["sonne"]), ("", ["a"]), ("aaa aa", ["aa", "aaa"]), ("rien", []), (None, ["a"]), ("x" * 50 + " eau-eau eau", ["eau", ""]), ('"é" e', ["e"])]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, w array<string>")
    found = {r.k: r.m for r in df.select("k", marks.marked(F.col("t"), F.col("w")).alias("m")).collect()}

    def plain(text, words):
        normal, at = "", []
        for i, c in enumerate(text):
            d = tx.LIGATURES.get(c) or "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M").lower()
            normal += d
            at += [i] * len(d)
        at.append(len(text))
        spots = [(at[m.start()], at[m.start() + len(w)]) for w in words if w for m in re.finditer(f"(?={re.escape(w)})", normal) if m.start() == 0 or not normal[m.start() - 1].isalnum()]
        out, end = "", 0
        for a, b in sorted(spots, key=lambda z: z[0]):
            if a >= end:
                out += html.escape(text[end:a], False).replace('"', "&quot;") + "<b>" + html.escape(text[a:b], False).replace('"', "&quot;") + "</b>"
                end = b
        return out + html.escape(text[end:], False).replace('"', "&quot;")

    assert found == {k: None if t is None else plain(t, w) for k, (t, w) in enumerate(cases)}
