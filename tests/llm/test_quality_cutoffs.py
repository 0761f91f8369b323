"""Cutoffs of the quality rules against a plain version with exact tails; the verdict that follows from them."""

from __future__ import annotations

import math
import random
from zlib import crc32

import pytest

from quillon.llm import quality_rules as qr

RATES = {
    "symbol_rate": lambda m: m["n_symbols"] / m["n_words"],
    "dup_line_rate": lambda m: m["n_dup_lines"] / m["n_lines"],
    "repeat_rate": lambda m: m["n_repeat_words"] / m["n_words"],
    "upper_rate": lambda m: m["n_upper"] / m["word_chars"],
    "long_words": lambda m: m["word_chars"] / m["n_words"],
    "short_words": lambda m: -m["word_chars"] / m["n_words"],
}


def made(seed: int, sizes: dict) -> tuple[list[dict], dict[int, int]]:
    rnd, rows, labels = random.Random(seed), [], {}
    for lang, size in sizes.items():
        for _ in range(size):
            n = rnd.randint(50, 400)
            doc = {"doc_id": len(rows), "lang": lang, "n_words": n, "word_chars": n * 3 + rnd.randint(0, 3 * n), "n_symbols": int(rnd.expovariate(0.3)), "n_lines": rnd.randint(1, 20), "n_dup_lines": int(rnd.random() < 0.1), "n_repeat_words": rnd.randint(0, 9), "n_upper": rnd.randint(0, n), "base_failed": rnd.random() < 0.1}
            rows.append(doc)
            labels[doc["doc_id"]] = int(rnd.random() < 0.9)
    return rows, labels


def plain(rows: list[dict], labels: dict[int, int], alpha: float, delta: float) -> dict:
    halves: dict = {}
    for m in rows:
        if labels.get(m["doc_id"]) == 1 and not m["base_failed"]:
            halves.setdefault(m["lang"], ([], []))[crc32(str(m["doc_id"]).encode()) % 2].append({r: f(m) for r, f in RATES.items()})
    halves = {k: v for k, v in halves.items() if v[0] and v[1]}
    out = {}
    for lang, (proposed, held) in halves.items():
        for q in sorted(qr.QUANTILES, reverse=True):
            cuts = {r: sorted(x[r] for x in proposed)[max(0, math.ceil(round(q * len(proposed), 9)) - 1)] for r in RATES}
            k, n = sum(any(x[r] > cuts[r] for r in RATES) for x in held), len(held)
            tail = sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))
            if k > n * alpha or tail > delta / len(halves):
                break
            out[lang] = cuts
    return out


@pytest.mark.parametrize(("seed", "sizes", "alpha"), [(1, {"en": 1500, None: 1200, "fr": 60}, 0.05), (2, {"en": 1400}, 0.1), (3, {"de": 5, "es": 1100}, 0.02)])
def test_cutoffs_against_plain(spark, seed, sizes, alpha):
    rows, labels = made(seed, sizes)
    kinds = ", ".join(f"{c} {'string' if c == 'lang' else 'boolean' if c == 'base_failed' else 'long'}" for c in rows[0])
    measured = spark.createDataFrame([tuple(m.values()) for m in rows], kinds)
    marks = spark.createDataFrame(list(labels.items()) + [(None, 1), (0, None)], "doc_id long, quality int")
    want = plain(rows, labels, alpha, 0.05)
    cuts = qr.cutoffs(measured, marks, alpha=alpha).collect()
    assert {c.stratum: {r: c[f"cut_{r}"] for r in RATES} for c in cuts} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    judged = {r.doc_id: r.kept for r in qr.judge(measured, qr.cutoffs(measured, marks, alpha=alpha)).collect()}
    over = lambda m: m["lang"] in want and any(f(m) > want[m["lang"]][r] for r, f in RATES.items())
    assert judged == {m["doc_id"]: not m["base_failed"] and not over(m) for m in rows}
    if seed == 2:
        assert 0 < sum(over(m) for m in rows) < 0.2 * len(rows)


def test_the_least_holdout(spark):
    """217 rows suffice for four strata at the defaults, 216 do not; and there are none without labels."""
    assert 0.98**217 <= 0.05 / 4 < 0.98**216
    rows, _ = made(4, {"en": 40})
    measured = spark.createDataFrame(rows)
    assert qr.cutoffs(measured, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
