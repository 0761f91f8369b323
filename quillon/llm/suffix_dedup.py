"""Removal of repeated byte strings with suffix arrays (operator 6).

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller doc_id. Documents whose whole
text repeats an earlier one are settled by a hash. In the others, each window of ``length`` bytes has a smallest k-gram hash; a
run of neighbouring windows with the same one is a segment, and equal windows anywhere have the same hash. Hashes that occur in
two documents are found first, on numbers alone; then the segments under such a hash meet in one place. Equal segments settle by
their smallest doc_id. The distinct segments of a hash are sorted into a suffix array, where equal windows stand next to each other.

The suffix array is built by prefix doubling on whole arrays: suffixes are ranked by a few symbols packed into one number, then by pairs
of ranks, until the wanted depth or until all differ. Only windows are compared here, so the depth is ``length``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import stage

#: Bytes of one k-gram, of segments sorted at a time, and of one hash's segments beyond which they are sorted in portions.
GRAM, BATCH, PORTION = 20, 1 << 17, 1 << 22


def ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in ascending order of their first ``depth`` symbols, rank of each suffix): equal ranks where those symbols are equal.

    Symbols are not negative; a suffix comes after a shorter one that it begins with."""
    n = len(text)
    bits = int(text.max(initial=0) + 1).bit_length()
    have = min(depth, max(1, 62 // bits))
    own = np.zeros(n + have, np.int64)
    own[:n] = text
    own[:n] += 1
    key = own[:n].copy()
    for k in range(1, have):
        key <<= bits
        key |= own[k : n + k]
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        step = np.empty(n, np.int64)
        step[:1] = 0
        np.cumsum(sorted_[1:] != sorted_[:-1], out=step[1:])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if have >= depth or n == 0 or step[-1] == n - 1:
            return order, rank
        more = min(have, depth - have)
        key = rank * (n + 1)
        key[: max(0, n - more)] += rank[more:] + 1
        have += more


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order."""
    return ranks(np.asarray(text, np.int64), len(text))[0].tolist()


def runs(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window) of the runs of windows with the same smallest k-gram hash, and all k-gram hashes; a text shorter than a window has no runs."""
    n = len(text)
    if n < length:
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.uint64)
    one = MIX[np.frombuffer(text, np.uint8)]
    # hash of 20 bytes from those of 1, 2, 4, 8 and 16 bytes
    parts, h = {1: one}, one
    for k in (1, 2, 4, 8):
        h = h[:-k] * ODD + (h[k:] ^ (h[k:] >> np.uint64(29)))
        parts[2 * k] = h
    m = n - GRAM + 1
    h = parts[16][:m] * ODD + parts[4][16 : 16 + m]
    h ^= h >> np.uint64(32)
    h *= ODD
    h ^= h >> np.uint64(29)
    # the smallest of the next length - GRAM + 1 hashes
    wide, have, grams = length - GRAM + 1, 1, h
    while 2 * have <= wide:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < wide:
        h = np.minimum(h[: len(h) - (wide - have)], h[wide - have :])
    first = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
    return h[first].view(np.int64), first, grams


def gram_places(grams: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """For runs of windows first to last, where in the segment the smallest k-gram stands; -1 if it stands there more than once."""
    wide = length - GRAM + 1
    at = first[:, None] + np.arange(2 * wide)
    own = np.where(at <= (last + wide - 1)[:, None], grams[np.minimum(at, len(grams) - 1)], np.uint64(0xFFFFFFFFFFFFFFFF))
    place = own.argmin(1)
    more = (own == own[np.arange(len(own)), place][:, None]).sum(1) > 1
    return np.where(more | (last - first >= wide), -1, place)


def alike(segments: list[bytes], places: list[int], length: int) -> list[bool]:
    """Whether a segment may share a window with another of the same hash.

    A shared window holds the k-gram and, left or right of it, at least half of its other bytes; so both segments agree in
    those. Where the k-gram's place is not unique all segments stay."""
    if min(places) < 0:
        return [True] * len(segments)
    half = (length - GRAM) // 2
    left = [x[g - half : g + GRAM] if g >= half else None for x, g in zip(segments, places, strict=True)]
    right = [x[g : g + GRAM + half] if g + GRAM + half <= len(x) else None for x, g in zip(segments, places, strict=True)]
    counts: dict = {}
    for x in left:
        counts[x, 0] = counts.get((x, 0), 0) + 1
    for x in right:
        counts[x, 1] = counts.get((x, 1), 0) + 1
    return [(a is not None and counts[a, 0] > 1) or (b is not None and counts[b, 1] > 1) for a, b in zip(left, right, strict=True)]


#: Seeded numbers for the bytes, and an odd multiplier.
MIX = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def _windows(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all segments, number of each byte's segment, whether a window starts there that ends in the segment)."""
    sizes = np.array([len(x) for x in segments], np.int64)
    owner = np.repeat(np.arange(len(segments), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(owner))
    return np.frombuffer(b"".join(segments), np.uint8), owner, left >= length


def _later(order: np.ndarray, rank: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of the windows in order, equal ones side by side and of equal rank, those whose doc is not the smallest of the equal ones."""
    own = rank[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    least = np.minimum.reduceat(docs[order], first)
    return order[docs[order] > np.repeat(least, np.diff(np.append(first, len(own))))]


def earliest(segments: list[bytes], docs: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each segment, with the smallest doc that has it whole, the ranges (first, last) of windows that also start in a segment of a smaller doc."""
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    text, owner, whole = _windows(segments, length)
    if not whole.any():
        return out
    order, rank = ranks(text, length)
    found = np.sort(_later(order[whole[order]], rank, np.array(docs, np.int64)[owner]))
    if not len(found):
        return out
    # the last window of a segment and the first of the next are not neighbours, as a window is longer than a byte
    cuts = np.flatnonzero(np.diff(found) != 1) + 1
    first, last = found[np.append(0, cuts)], found[np.append(cuts, len(found)) - 1]
    begin = np.cumsum([0, *map(len, segments)])
    segment = owner[first]
    for k, a, b in zip(segment.tolist(), (first - begin[segment]).tolist(), (last - begin[segment]).tolist(), strict=True):
        out[k].append((a, b))
    return out


def _window_hashes(text: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each place on; the last ones have no whole window."""
    power = np.full(len(text) + 1, ODD)
    power[0] = 1
    back = np.full(len(text) + 1, np.uint64(pow(int(ODD), -1, 1 << 64)))
    back[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(MIX[text] * np.cumprod(power)[:-1], dtype=np.uint64)])
    h = (total[length:] - total[:-length]) * np.cumprod(back)[: len(total) - length]
    h ^= h >> np.uint64(32)
    h *= ODD
    h ^= h >> np.uint64(29)
    return np.concatenate([h, np.zeros(length - 1, np.uint64)])


def in_portions(segments: list[bytes], docs: list[int], length: int) -> list[list[tuple[int, int]]]:
    """earliest() for segments of any total size: beyond PORTION bytes the windows whose hash occurs twice are dealt by it, and sorted one lot at a time."""
    if sum(map(len, segments)) <= PORTION:
        return earliest(segments, docs, length)
    text, owner, whole = _windows(segments, length)
    at = np.flatnonzero(whole)
    hashes = _window_hashes(text, length)[at]
    order = np.argsort(hashes)
    at, hashes = at[order], hashes[order]
    same = hashes[1:] == hashes[:-1]
    twice = np.append(same, False) | np.append(False, same)
    at, hashes = at[twice], hashes[twice]
    begin = np.cumsum([0, *map(len, segments)])
    ids = np.array(docs, np.int64)
    found: list[list[tuple[int, int]]] = [[] for _ in segments]
    step = max(2, PORTION // length)
    start = 0
    while start < len(at):
        # a lot ends where a hash does
        end = int(np.searchsorted(hashes, hashes[min(start + step, len(at)) - 1], "right"))
        own = at[start:end]
        start = end
        windows = [text[o : o + length].tobytes() for o in own.tolist()]
        for o, ranges in zip(own.tolist(), earliest(windows, ids[owner[own]].tolist(), length), strict=True):
            if ranges:
                k = int(owner[o])
                found[k].append((o - int(begin[k]), o - int(begin[k])))
    return [_joined(x) for x in found]


def _joined(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, neighbours as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _resolve(length: int):
    """Rows (h, seg, doc_id, at, gram, least), those of a hash and segment together, to (doc_id, start, end) of covered bytes."""

    def run(batches):
        import pyarrow as pa

        waiting: list[tuple[list[bytes], list[int], list[list[int]]]] = []
        size = 0
        out: tuple[list[int], list[int], list[int]] = ([], [], [])

        def cover(doc: int, start: int, end: int) -> None:
            out[0].append(doc)
            out[1].append(start)
            out[2].append(end)

        def sort_all() -> None:
            segments, docs, places = ([x for w in waiting for x in w[i]] for i in range(3))
            for doc, own, ranges in zip(docs, places, in_portions(segments, docs, length), strict=True):
                for a, b in ranges:
                    for at in own:
                        cover(doc, at + a, at + b + length)
            waiting.clear()

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "end"])
            for x in out:
                x.clear()
            return made

        def wait(segments: list[bytes], docs: list[int], places: list[list[int]], grams: list[int]) -> int:
            """Put the segments of a hash that may share windows in line; how many bytes they have."""
            if len(segments) < 2:
                return 0
            keep = alike(segments, grams, length)
            if not any(keep):
                return 0
            waiting.append(tuple([v for v, k in zip(x, keep, strict=True) if k] for x in (segments, docs, places)))
            return sum(map(len, waiting[-1][0]))

        now, segments, docs, places, grams = None, [], [], [], []
        for batch in batches:
            for h, seg, doc, at, gram, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != now:
                    size += wait(segments, docs, places, grams)
                    if size > BATCH:
                        sort_all()
                        size = 0
                    now, segments, docs, places, grams = h, [], [], [], []
                if not segments or seg != segments[-1]:
                    segments.append(seg)
                    docs.append(least)
                    places.append([])
                    grams.append(gram)
                if doc == least:
                    places[-1].append(at)
                else:
                    cover(doc, at, at + len(seg))
            yield flush()
        wait(segments, docs, places, grams)
        if waiting:
            sort_all()
        yield flush()

    return run


def known(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, n_bytes, first): of every row its text's SHA-256 and the smallest doc_id with that text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes")), "hashes")
    return rows.join(rows.groupBy("sha").agg(F.min("doc_id").alias("first")), "sha")


def spans(docs: DataFrame, length: int = 50, hashes: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans array<struct<start, end>>) of the documents that lose bytes: maximal runs, in order, as byte offsets.

    Null texts are empty; a row with a null doc_id neither loses bytes nor takes any from others; rows that repeat a doc_id are
    one document. An empty table gives an empty result.
    """
    hashes = stage(known(docs), "known") if hashes is None else hashes
    copies = hashes.where((F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= length))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            ids, rows = np.asarray(batch.column(0)), batch.column(1).cast(pa.binary()).to_pylist()
            for k in range(0, len(rows), 256):
                found = [np.unique(runs(x, length)[0]) for x in rows[k : k + 256]]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(ids[k : k + 256], [len(x) for x in found]))], ["h", "doc_id"])

    one = texts.join(copies.select("doc_id").distinct(), "doc_id", "left_anti").mapInArrow(hashed, "h long, doc_id long")
    w = Window.partitionBy("h")
    shared = one.withColumns({"low": F.min("doc_id").over(w), "high": F.max("doc_id").over(w)}).where("low < high")
    wanted = stage(shared.groupBy("doc_id").agg(F.collect_list("h").alias("hs")), "shared")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            ids, rows, lists = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text, own in zip(ids, rows, lists, strict=True):
                h, first, grams = runs(text, length)
                ends = np.append(first[1:], len(text) - length + 1) - 1 + length
                keep = np.isin(h, np.array(own, np.int64))
                a, b = first[keep].tolist(), ends[keep].tolist()
                out[0].extend(h[keep].tolist())
                out[1].extend([text[i:j] for i, j in zip(a, b, strict=True)])
                out[2].extend([doc] * len(a))
                out[3].extend(a)
                out[4].extend(gram_places(grams, first[keep], ends[keep] - length, length).tolist() if a else [])
                if len(out[0]) > 50_000:
                    yield pack(out)
            yield pack(out)

    def pack(out):
        import pyarrow as pa

        made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32())], ["h", "seg", "doc_id", "at", "gram"])
        for x in out:
            x.clear()
        return made

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = texts.join(wanted, "doc_id").select("doc_id", "text", "hs").mapInArrow(cut, "h long, seg binary, doc_id long, at long, gram int").repartition(parts, "h")
    found = found.withColumn("least", F.min("doc_id").over(Window.partitionBy("h", "seg"))).sortWithinPartitions("h", "seg")
    covered = stage(found.select("h", "seg", "doc_id", "at", "gram", "least").mapInArrow(_resolve(length), "doc_id long, start long, end long").distinct(), "covered")
    merged = covered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("x"))

    def merge(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for own in batch.column(1).to_pylist():
                joined: list[dict] = []
                for x in own:
                    if joined and x["start"] <= joined[-1]["end"]:
                        joined[-1]["end"] = max(joined[-1]["end"], x["end"])
                    else:
                        joined.append(dict(x))
                made.append(joined)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])

    whole = copies.select("doc_id", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans")).dropDuplicates(["doc_id"])
    return stage(merged.mapInArrow(merge, "doc_id long, spans array<struct<start:bigint,end:bigint>>").union(whole), "spans")


def kept(texts: DataFrame) -> DataFrame:
    """(doc_id, kept binary, spans) from rows with doc_id, text and spans: the bytes outside the spans."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for text, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, parts, at = text or b"", [], 0
                for x in own or ():
                    parts.append(text[at : x["start"]])
                    at = x["end"]
                made.append(b"".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], ["doc_id", "kept", "spans"])

    return texts.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), "spans").mapInArrow(run, "doc_id long, kept binary, spans array<struct<start:bigint,end:bigint>>")
