"""Language identification by rank-order profiles (operator 2).

A profile is the list of the most frequent letter n-grams (1 to 5, words padded with a blank) in order of frequency. A language's
profile comes from labelled documents, a document's from its whole text; the language whose profile is nearest by the
out-of-place distance (sum of rank differences, an n-gram that the language lacks costs the whole profile length) is the guess.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


WORD = re.compile("[^\\W\\d_]+").findall
#: Odd multiplier of the n-grams' numbers, characters of a text counted at a time.
ODD, PIECE = np.uint64(0x9E3779B97F4A7C15), 1 << 20


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order and the sums of their counts."""
    order = np.argsort(grams)
    grams = grams[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    return grams[first], np.add.reduceat(counts[order], first)


def _counted(text: str, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of words with one blank before, between and after them, and how often each occurs."""
    at = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    letter = at != 32
    # an n-gram lies within a word and the blanks beside it: none but its first and last character may be a blank
    gram, inner, found = np.zeros(len(at), np.uint64), np.ones(len(at), bool), []
    for k in range(1, longest + 1):
        n = len(at) - k + 1
        if n < 1:
            break
        gram = (gram[:n] + at[k - 1 :]) * ODD
        gram ^= gram >> np.uint64(29)
        if k > 2:
            inner = inner[:n] & letter[k - 2 : len(at) - 1]
        found.append(gram[letter] if k == 1 else gram[inner[:n]])
    grams = np.sort(np.concatenate(found))
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    return grams[first], np.diff(first, append=len(grams))


def count(text: str, longest: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of a text's distinct n-grams and how often each occurs."""
    text = " ".join(WORD(text.lower()))
    if not text.replace(" ", "").isalpha():  # numeric marks are no letters
        text = " ".join("".join(c if c.isalpha() else " " for c in text).split())
    found, start = [], 0
    while start < len(text):
        end = text.find(" ", start + PIECE) if len(text) - start > PIECE else -1
        end = len(text) if end < 0 else end
        found.append(_counted(f" {text[start:end]} ", longest))
        start = end + 1
    if not found:
        return np.array([], np.uint64), np.array([], np.int64)
    return found[0] if len(found) == 1 else _summed(*map(np.concatenate, zip(*found, strict=True)))


def top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by number."""
    if len(counts) > size:
        # only those that can be among the first: the rest of the sort is not needed
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:size]]


def profiles(docs: DataFrame, size: int = 400, sample: int = 4000) -> dict[str, np.ndarray]:
    """Profile by language, from text and non-null lang of docs.

    Of each language about ``sample`` documents are taken, those whose hash of doc_id is low: a bounded sample of labelled rows.
    Counting runs on the executors; to the driver come ``size`` numbers a language, for every language that occurs."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text", "doc_id")
    totals = rows.groupBy("lang").count()
    rows = rows.join(F.broadcast(totals), "lang")  # a row a language: texts stay where they are read
    rows = rows.where(F.expr(f"pmod(xxhash64(11, doc_id), 1000000007) * cast(count as double) < {sample} * 1000000007.0D"))

    def run(batches):
        import pyarrow as pa

        sums = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(lang, {})
                for g, n in zip(*(x.tolist() for x in count(text)), strict=True):
                    own[g] = own.get(g, 0) + n
            for lang, own in sums.items():
                if len(own) > 200_000:
                    yield table(lang, own)
                    own.clear()
        for lang, own in sums.items():
            yield table(lang, own)

    def table(lang, own):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(np.array(list(own), np.uint64).view(np.int64)), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])

    counts = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    found: dict[str, list] = {}
    for lang, gram, _, rank in sorted(best.collect(), key=lambda r: (r[0], r[3])):
        found.setdefault(lang, []).append(gram)
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in found.items()}


def predict(docs: DataFrame, known: dict[str, np.ndarray], size: int = 400) -> DataFrame:
    """(doc_id, lang_pred, score) of every row: score is the runner-up's share of both distances, 0.5 for a tie and 1 for a perfect fit.

    ``und`` with score 0: null text, a text without a letter, or no known language. Ties go to the first language by name."""
    names = sorted(known)
    # the n-grams of all profiles, and for each language its rank of them, -1 if it lacks one; the last row stands for all other n-grams
    union = np.unique(np.concatenate([known[x] for x in names])) if names else np.array([], np.uint64)
    ranks = np.full((len(union) + 1, len(names)), -1, np.int32)
    for k, x in enumerate(names):
        ranks[np.searchsorted(union, known[x]), k] = np.arange(len(known[x]))

    def distances(mine: np.ndarray) -> list[int]:
        at = np.minimum(np.searchsorted(union, mine), len(union) - 1)
        theirs = ranks[np.where(union[at] == mine, at, len(union))]
        return np.where(theirs >= 0, np.abs(theirs - np.arange(len(mine), dtype=np.int32)[:, None]), size).sum(0, dtype=np.int64).tolist()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            guesses, scores = [], []
            for text in batch.column(1).to_pylist():
                mine = top(*count(text or ""), size)
                if not len(mine) or not names:
                    guesses.append("und")
                    scores.append(0.0)
                    continue
                far = distances(mine)
                first = min(range(len(names)), key=far.__getitem__)
                second = min((far[k] for k in range(len(names)) if k != first), default=size * len(mine))
                guesses.append(names[first])
                scores.append(second / (far[first] + second) if far[first] + second else 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(guesses, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, training: DataFrame, size: int = 400, sample: int = 4000) -> DataFrame:
    """Profiles of training (text, lang, doc_id), then a prediction for every row of docs from its text alone.

    Repeated rows get a row each, null ids stay null, other columns are not read; very long texts are counted whole. An empty table
    gives an empty result."""
    return predict(docs, profiles(training, size, sample), size)
