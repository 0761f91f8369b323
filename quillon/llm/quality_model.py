"""Quality classifier: a generalised additive model with pairwise interactions (operator 9).

Features of a text are cut into bins. Boosting goes round the features, each time fitting a shallow tree (three cuts, on the
bins) to the gradient of the logistic loss and adding a small step of it to that feature's lookup table; then pairs whose
residual interaction is strongest are boosted the same way with trees on two features. A score is a sum of table entries looked
up by bin, for a whole batch of documents at a time.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ["log_words", "word_len", "word_len_sd", "upper", "digit", "symbol", "punct", "bang", "pipe", "unique", "top_word", "repeat_pair", "log_lines", "dup_lines", "line_len", "end_mark", "space", "non_ascii", "short_words", "long_words"]
BINS = 32


def features(text: str | None) -> list[float]:
    """The features of one whole text; all are finite, also for null and empty texts."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(len(words), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    chars = max(len(text), 1)
    per = lambda marks: float(seen[list(marks)].sum()) / n
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(len(lines), 1)
    return [
        float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()), float(seen[65:91].sum()) / chars, float(seen[48:58].sum()) / chars,
        per(b"#*$%&|<>"), per(b".,;:?"), per(b"!"), per(b"|"), len(counts) / n, max(counts.values(), default=0) / n, 1 - pairs / max(len(words) - 1, 1),
        float(np.log1p(len(lines))), 1 - len(set(lines)) / m, len(words) / m, sum(x.rstrip()[-1:] in (".", "!", "?") for x in lines) / m, float(seen[32]) / chars,
        float(seen[128:].sum()) / max(len(raw), 1), float((lengths <= 2).mean()), float((lengths >= 12).mean()),
    ]


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<float>) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def tree(gradient: np.ndarray, weight: np.ndarray, cuts: int = 3, least: float = 1.0) -> np.ndarray:
    """A tree on one binned feature: the Newton step of each bin's leaf. Cuts are taken greedily where they gain most."""
    g, h = np.cumsum(gradient), np.cumsum(weight)
    edges = [0, len(gradient)]
    sums = lambda c, a, b: c[b - 1] - (c[a - 1] if a else 0.0)
    for _ in range(cuts):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a < 2:
                continue
            gl, hl = g[a : b - 1] - (g[a - 1] if a else 0.0), h[a : b - 1] - (h[a - 1] if a else 0.0)
            gt, ht = sums(g, a, b), sums(h, a, b)
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < least) | (ht - hl < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), a + k + 1)
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = sums(g, a, b) / (sums(h, a, b) + 1)
    return out


class Model:
    """Lookup tables of a fitted model."""

    def __init__(self, rounds: int = 250, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.08):
        self.rounds, self.pair_rounds, self.n_pairs, self.rate = rounds, pair_rounds, pairs, rate
        self.start, self.edges, self.single, self.double = 0.0, [], np.zeros((0, BINS)), []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        b, p = self.bins(x), np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        self.single = np.zeros((x.shape[1], BINS))
        score = np.full(len(y), self.start)
        chance = lambda: 1 / (1 + np.exp(-score))
        for _ in range(self.rounds):
            for k in range(x.shape[1]):
                q = chance()
                step = self.rate * tree(np.bincount(b[:, k], y - q, BINS), np.bincount(b[:, k], q * (1 - q), BINS))
                self.single[k] += step
                score += step[b[:, k]]
        small = b // (BINS // 8)
        q = chance()
        gains = []
        for i, j in combinations(range(x.shape[1]), 2):
            cell = small[:, i] * 8 + small[:, j]
            g, h = np.bincount(cell, y - q, 64), np.bincount(cell, q * (1 - q), 64)
            gains.append((float((g**2 / (h + 5)).sum()), i, j))
        for _, i, j in sorted(gains, reverse=True)[: self.n_pairs]:
            self.double.append([i, j, np.zeros(64)])
        for _ in range(self.pair_rounds):
            for pair in self.double:
                i, j, table = pair
                q = chance()
                cell = small[:, i] * 8 + small[:, j]
                g, h = np.bincount(cell, y - q, 64).reshape(8, 8), np.bincount(cell, q * (1 - q), 64).reshape(8, 8)
                step = np.zeros((8, 8))
                # one cut on the first feature, then a tree on the second in either part
                tops = tree(g.sum(1), h.sum(1), 1)
                cut = int(np.argmax(np.abs(np.diff(tops)))) + 1
                for part in (slice(0, cut), slice(cut, 8)):
                    step[part] = tree(g[part].sum(0), h[part].sum(0), 2)
                table += self.rate * step.ravel()
                score += self.rate * step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row."""
        b = self.bins(x)
        total = self.start + self.single[np.arange(b.shape[1]), b].sum(1)
        small = b // (BINS // 8)
        for i, j, table in self.double:
            total += table[small[:, i] * 8 + small[:, j]]
        return 1 / (1 + np.exp(-total))


def train(rows: DataFrame, labels: DataFrame, sample: int = 20_000, **how) -> Model | None:
    """Fit on at most about ``sample`` labelled rows (lowest hashes of doc_id: a bounded sample), gathered as features only.

    Labels that repeat a document count by their lowest quality; null labels are left out; no labels give None."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    if not n:
        return None
    share = min(1.0, sample / n)
    known = known.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000_007)) < int(share * 1_000_000_007))
    found = rows.join(known, "doc_id").select("doc_id", "x", "quality").toPandas().sort_values("doc_id", kind="stable")
    if not len(found):
        return None
    return Model(**how).fit(np.array(found["x"].tolist(), np.float32), (found["quality"] > 0).to_numpy(float))


def scored(rows: DataFrame, model: Model | None) -> DataFrame:
    """rows (doc_id, x) to (doc_id, score); without a model every score is 0.5."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float32).reshape(batch.num_rows, -1)
            found = model.score(x) if model and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
