"""Best-fit packing into fixed-length sequences by patterns (operator 7).

The histogram of piece lengths, at most ``capacity`` numbers, decides everything: patterns of two and three lengths that fill a
sequence exactly are enumerated, non-negative least squares fits their repeat counts to the histogram, the counts are rounded
down, and what is left is packed best-fit decreasing, still on counts. The resulting table of slots is applied to the pieces by
their rank among the pieces of the same length; ranks come from counts per (length, salt), so a length that a third of all
pieces share is no hot group. Only the histogram and the slot table pass the driver; neither grows with the rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import stage, word_ids


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every whole text, tokenized with ``end`` appended; null: empty.

    Only documents of more than ``capacity`` ids are cut."""

    def run(batches):
        from zlib import crc32

        import pyarrow as pa

        ids, stop, step = word_ids(vocabulary), np.array([end], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            out = []
            for doc, found in zip(batch.column(0).to_pylist(), ids.texts(batch.column(1).cast(pa.binary()).to_pylist()), strict=True):
                found += stop
                out += [(doc, k, a // 4, (min(len(found), a + step) - a) // 4, crc32(found[a : a + step])) for k, a in enumerate(range(0, len(found), step))]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")


def patterns(counts: np.ndarray) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, c = 0 for two: all lengths that occur and add up to the capacity, len(counts) - 1."""
    capacity = len(counts) - 1
    there = counts > 0
    there[[0, capacity]] = False
    a = np.flatnonzero(there)
    two = a[(2 * a >= capacity) & there[capacity - a]]
    found = [np.stack([two, capacity - two, np.zeros_like(two)], 1)]
    for x in a[::-1]:
        b = a[(a <= x) & (2 * a >= capacity - x) & (a < capacity - x)]
        b = b[there[capacity - x - b]]
        found.append(np.stack([np.full_like(b, x), b, capacity - x - b], 1))
    return np.concatenate(found)


def fit(counts: np.ndarray, rows: np.ndarray, sweeps: int = 4) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts| by coordinate descent; column j of A counts the lengths of pattern j."""
    left = counts.astype(float).tolist()
    left[0] = 0.0
    x = [0.0] * len(rows)
    triples = rows.tolist()
    norms = [sum(v * v for k, v in Counter(t).items() if k) for t in triples]
    for _ in range(sweeps):
        for j, (a, b, c) in enumerate(triples):
            step = (left[a] + left[b] + (left[c] if c else 0.0)) / norms[j]
            if step < -x[j]:
                step = -x[j]
            if step:
                x[j] += step
                left[a] -= step
                left[b] -= step
                if c:
                    left[c] -= step
    return np.array(x)


def best_fit(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: (lengths of a sequence, repeats)."""
    capacity = len(counts) - 1
    room: list[list[list]] = [[] for _ in range(capacity + 1)]
    done = []
    for size in range(capacity, 0, -1):
        left, at = int(counts[size]), size
        while left:
            while at <= capacity and not room[at]:
                at += 1
            if at > capacity:
                group, at = [{}, left], capacity
            else:
                group = room[at].pop()
            n = min(left, group[1])
            if n < group[1]:
                room[at].append([group[0], group[1] - n])
            items = {**group[0], size: group[0].get(size, 0) + 1}
            left -= n
            (room[at - size] if at > size else done).append([items, n])
            at = max(size, min(at, at - size if at - size >= size else at))
    return [(items, n) for items, n in done + [g for groups in room for g in groups]]


def plan(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Sequences for a histogram: (lengths of a sequence, repeats). counts[l] pieces have length l."""
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    out = [({capacity: 1}, int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    rows = patterns(left)
    if len(rows):
        x = np.floor(fit(left, rows) + 1e-6).astype(np.int64)
        for j in np.argsort(-x, kind="stable")[: np.count_nonzero(x)].tolist():
            items = Counter(v for v in rows[j].tolist() if v)
            n = min(int(x[j]), *(int(left[v]) // m for v, m in items.items()))
            if n > 0:
                out.append((dict(items), n))
                for v, m in items.items():
                    left[v] -= n * m
    return out + best_fit(left)


def slots(sequences: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Columns length, first rank, first sequence, pieces of that length in a sequence, offset of the first; by length and rank."""
    rank, out, first = Counter(), [], 0
    for items, n in sequences:
        offset = 0
        for size in sorted(items, reverse=True):
            out.append((size, rank[size], first, items[size], offset))
            rank[size] += n * items[size]
            offset += size * items[size]
        first += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = 2048, salts: int | None = None) -> DataFrame:
    """found (doc_id, piece, length, ...) with sequence_id and offset.

    Lengths are 1 to capacity; a row of another or of null length raises an error. Repeated rows are packed each. An empty table
    gives an empty result. Sequence numbers are dense; only ends of sequences have room."""
    salts = salts or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    found = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sums = stage(found.groupBy("length", "_salt").agg(F.count("*").alias("n")), "histogram")
    rows = sums.groupBy("length").agg(F.sum("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows:
        if length is None or not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length}; the capacity is {capacity}")
        counts[length] = n
    table = slots(plan(counts))
    base = sums.select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_base"))
    ranked = found.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_salt", "_base")
    ranked = ranked.select(*[c for c in ranked.columns if c != "_rank"], "_rank")

    def place(batches):
        import pyarrow as pa

        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            at = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            k = rank - at[:, 1]
            made = [pa.array(at[:, 2] + k // at[:, 3]), pa.array(at[:, 4] + k % at[:, 3] * length)] if len(length) else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row."""
    return pack(stage(pieces(docs, vocabulary, capacity, end), "pieces"), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
