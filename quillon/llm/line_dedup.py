"""Near-duplicate lines by an exact set-similarity join (operator 3).

A line is the set of its words, lower-cased. A line goes if a line with Jaccard similarity of at least ``similarity`` comes
before it in (doc_id, line number) order; the input decides, not what is left. Words are ordered by rarity, from counts over the
whole table in a fixed number of slots: any order that depends on the word alone gives exact results. Two similar lines then
share a word in their prefixes, n - ceil(t n) + 1 words, which is their key. Where the first shared word is frequent, the key
takes the next shared one too, from a prefix one longer, and a third one where the two are likely to meet often. A word that
occurs once is no key. Length, position and a 128-bit parity bitmap of the words (its difference is at most the difference of the
sets) filter candidates; the rest are verified on the 64-bit hashes of all their words, read from the texts again.

Equal sets, told by a 64-bit hash of their words' whole 64-bit hashes, settle by their first place, so only distinct sets are compared. Their key rows travel in arrays, one for each of a
number of key ranges, and meet there in order of size: a set is held against the smaller ones that its position allows, among those
whose positions allow larger ones. Under a key where these are more than NEAR, or more than FEW of them pass the filters, only some and
the key's first set are compared; the sets that find no match that way go to a full join on those keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import free, release, stage

SLOTS = 1 << 21
#: Expected sets under a key from which it takes one more word.
FREQUENT = 1024
#: Bytes of text, lines and key rows that a task handles at a time.
WINDOW, LINES, ROWS = 1 << 20, 1 << 16, 1 << 20
#: Smaller sets that a set is compared with under a key, and candidates among them that go on to be verified.
NEAR, FEW = 2048, 8
#: Key ranges for each shuffle partition, and rows of one range that are compared at a time.
FINE, LOT = 8, 1 << 22
#: A key row, column after column in an array: key, place, size, words left out before the key's last one, set, bitmap in two parts; and a set's row: set, doc_id, line.
KEY = [("key", "<u4"), ("place", "<u4"), ("n", "<u4"), ("i", "<u4"), ("s", "<i8"), ("bits", "<u8"), ("more", "<u8")]
SET = [("s", "<i8"), ("doc_id", "<i8"), ("line", "<i4")]
PLANES = {"place", "n", "i"}
KEYS, SETS, GONE = range(3)
WIDTH = sum(np.dtype(t).itemsize for _, t in KEY)
NULL = -(1 << 63)
#: Seeded numbers for the bytes, and which bytes are no white space.
BYTES = np.random.default_rng(80).integers(0, 1 << 64, 256, dtype=np.uint64)
SOLID = np.array([not bytes([x]).isspace() for x in range(256)], np.int8)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and those of its inverse modulo 2^64."""
    odd = 0x9E3779B97F4A7C15
    made = [np.full(size, x, np.uint64) for x in (odd, pow(odd, -1, 1 << 64))]
    for x in made:
        x[0] = 1
    return np.cumprod(made[0]), np.cumprod(made[1])


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(begin, 64-bit hash) of the words of a lower-cased text: sums of its bytes' numbers times powers, from running sums."""
    data = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate([[0], SOLID[data], [0]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.empty(len(begin), np.uint64)
    k = 0
    while k < len(begin):
        # words of about WINDOW bytes at a time, one at least
        m = max(k + 1, int(np.searchsorted(end, begin[k] + WINDOW, "right")))
        a, b = int(begin[k]), int(end[m - 1])
        up, down = powers(1 << max(20, (b - a).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data[a:b]] * up[: b - a])])
        out[k:m] = mixed((sums[end[k:m] - a] - sums[begin[k:m] - a]) * down[begin[k:m] - a])
        k = m
    return begin, out


def lots(batches) -> Iterator[tuple[list[int], list[bytes]]]:
    """(doc_ids, lower-cased texts), about WINDOW bytes at a time."""
    import pyarrow as pa

    ids, texts, size = [], [], 0
    for batch in batches:
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if text:
                ids.append(NULL if d is None else d)
                texts.append(text.lower())
                size += len(text)
                if size > WINDOW:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def rarity(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Word counts over all texts, by slot, as steps of half a power of two: SLOTS bytes, whatever the input; level 2 is a word
    that occurs once. And the number of lines."""

    def run(batches):
        import pyarrow as pa

        total, lines = np.zeros(SLOTS, np.int64), 0
        for _, texts in lots(batches):
            text = b"\n".join(texts)
            at, n = np.unique(hashed(text)[1] & np.uint64(SLOTS - 1), return_counts=True)
            total[at] += n
            lines += text.count(b"\n") + 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], lines))], ["slot", "n"])

    rows = docs.select(F.lit(0), F.col("text").cast("string").alias("text")).mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    slot, n = np.asarray(rows.column("slot")), np.asarray(rows.column("n"))
    out[slot[slot >= 0]] = np.round(2 * np.log2(n[slot >= 0] + 1.0)).astype(np.uint8)
    return out, int(n[slot < 0].sum())


def sets_of(hashes: np.ndarray, line: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of lines 0 to 65,535, by hash, to (line, word numbers, their hashes, begin of each line's words, their count).

    A number is the level of the word's count above 40 bits of its hash: numbers in order have the rarest first. Words are told
    apart by their whole hashes; two of one number both stay, in any order, and count as two."""
    found = (line.astype(np.uint64) << np.uint64(48)) | (levels[hashes & np.uint64(SLOTS - 1)].astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    order = np.argsort(found)
    found, hashes = found[order], hashes[order]
    if len(found):
        same, alike = found[1:] == found[:-1], hashes[1:] == hashes[:-1]
        if (same & ~alike).any():  # words of one number: put the repeats of each together
            order = np.lexsort((hashes, found))
            found, hashes = found[order], hashes[order]
            alike = hashes[1:] == hashes[:-1]
        new = np.append(True, ~(same & alike))
        found, hashes = found[new], hashes[new]
    n = np.bincount((found >> np.uint64(48)).astype(np.int64))
    line = np.flatnonzero(n)
    return line, found & np.uint64((1 << 48) - 1), hashes, np.cumsum(n[line]) - n[line], n[line]


def identity(hashes: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set of words, by their whole hashes, a 64-bit hash and a parity bitmap of 128 bits in two parts."""
    hashes = mixed(hashes)
    s = mixed(np.add.reduceat(hashes, begin) + n.astype(np.uint64))
    bit, second = np.uint64(1) << (hashes >> np.uint64(58)), (hashes & np.uint64(1)).astype(bool)
    return s.view(np.int64), *(np.bitwise_xor.reduceat(np.where(second == k, bit, np.uint64(0)), begin) for k in (False, True))


def keys(words: np.ndarray, begin: np.ndarray, n: np.ndarray, similarity: float, total: float, frequent: float = FREQUENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key hash, set, words left out before its last word) of sets of four words or more; smaller ones match equals only.

    total: lines of the corpus, which turns the counts of words into an expected number of lines that have them all. Two similar
    sets share four words at least, and miss no more than prefix - 1 of the words before the k-th that they share."""
    count = lambda at: np.exp2((words[at] >> np.uint64(40)).astype(float) / 2)
    prefix = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    prefix[n < 4] = 0
    owner = np.repeat(np.arange(len(n)), prefix)
    i = np.arange(len(owner)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    last = begin + np.minimum(prefix, n) - 1

    def longer(owner, at, key, expected, size):
        """Keys of ``size`` words from those of one word less, which end at the places at."""
        d = 0
        while len(at):
            d += 1
            keep = at + d <= np.minimum(last[owner] + size - 1, begin[owner] + n[owner] - 1)
            owner, at, key, expected = owner[keep], at[keep], key[keep], expected[keep]
            made, fewer = mixed(key * np.uint64(3) + mixed(words[at + d])), expected * count(at + d) / total
            rare = fewer <= frequent if size < 4 else np.full(len(at), True)
            yield made[rare], owner[rare], (at + d - begin[owner] - size + 1)[rare]
            if not rare.all():
                yield from longer(*(x[~rare] for x in (owner, at + d, made, fewer)), size + 1)

    at = begin[owner] + i
    expected = count(at)
    one = (expected <= frequent) & ((words[at] >> np.uint64(40)) > 2)
    yield mixed(words[at[one]]), owner[one], i[one]
    more = expected > frequent
    yield from longer(owner[more], at[more], mixed(words[at[more]]), expected[more], 2)


def packed(columns: list[np.ndarray], layout: list[tuple[str, str]], bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, its rows column after column, small numbers by byte plane: their high bytes, mostly zero or alike, compress well)."""
    order = np.argsort(bucket, kind="stable")
    columns = [np.asarray(c, t)[order] for c, (_, t) in zip(columns, layout, strict=True)]
    bucket = bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() if len(bucket) else []
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        yield int(bucket[a]), b"".join([(c[a:b].view(np.uint8).reshape(b - a, -1).T if name in PLANES else c[a:b]).tobytes() for c, (name, _) in zip(columns, layout, strict=True)])


def unpacked(parts: list[bytes], layout: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """The rows of arrays made by packed()."""
    width = sum(np.dtype(t).itemsize for _, t in layout)
    out, skip = {}, 0
    for name, t in layout:
        size = np.dtype(t).itemsize
        if name in PLANES:
            planes = [np.frombuffer(x, np.uint8, len(x) // width * size, len(x) // width * skip).reshape(size, -1).T for x in parts]
            out[name] = np.ascontiguousarray(np.concatenate(planes)).view(t).ravel()
        else:
            out[name] = np.concatenate([np.frombuffer(x, t, len(x) // width, len(x) // width * skip) for x in parts])
        skip += size
    return out


def signatures(docs: DataFrame, levels: np.ndarray, total: int, similarity: float, buckets: int) -> DataFrame:
    """(kind, bucket, data): arrays of key rows by key, of sets with their first place in a lot of lines by set, and of the
    places of lines in the lot that repeat a set."""
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    low, span = low or 0, max(1, (high or 0) - (low or 0) + 1)

    def run(batches):
        import pyarrow as pa

        def table(kind: int, rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["kind", "bucket", "data"])

        def pieces():
            """(doc_id and line number of each line with words, word numbers, hashes, their begin, their count), for at most 65,536 lines at a time."""
            for ids, texts in lots(batches):
                text = b"\n".join(texts)
                many = np.array([x.count(b"\n") + 1 for x in texts])
                doc = np.repeat(np.array(ids, np.int64), many)
                no = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                begin, hashes = hashed(text)
                line = np.searchsorted(np.flatnonzero(np.frombuffer(text, np.uint8) == 10), begin)
                for at in range(0, len(doc), LINES):
                    a, b = np.searchsorted(line, [at, at + LINES])
                    if a < b:
                        own, *rest = sets_of(hashes[a:b], line[a:b] - at, levels)
                        yield doc[own + at], no[own + at], *rest

        for own_doc, own_no, words, hashes, begin, n in pieces():
            s, bits, more = identity(hashes, begin, n)
            order = np.lexsort((own_no, own_doc, s))
            new = np.append(True, s[order][1:] != s[order][:-1])[: len(order)]
            lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            again = order[(own_doc[order] > own_doc[lead]) | (own_no[order] > own_no[lead])]
            keep = np.sort(order[new])
            yield table(GONE, list(packed([s[again], own_doc[again], own_no[again]], SET, (own_doc[again] % buckets).astype(np.uint16))))
            yield table(SETS, list(packed([s[keep], own_doc[keep], own_no[keep]], SET, (s[keep].view(np.uint64) % np.uint64(buckets)).astype(np.uint16))))
            place = np.where(own_doc == NULL, 0.0, 1 + (own_doc - low) / span * ((1 << 32) - 2)).astype(np.uint32)
            only = np.zeros(len(n), np.int64)
            only[keep] = n[keep]
            held, size = [], 0

            def flush():
                key, owner, i = (np.concatenate(x) for x in zip(*held, strict=True))
                rows = [key.astype(np.uint32), place[owner], n[owner], i, s[owner], bits[owner], more[owner]]
                held.clear()
                return table(KEYS, list(packed(rows, KEY, ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16))))

            for key, owner, i in keys(words, begin, only, similarity, total):
                held.append((key, owner, i))
                size += len(key)
                if size > ROWS:
                    yield flush()
                    size = 0
            if size:
                yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "kind int, bucket int, data binary")


def could(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs may have similar words, by bitmap, size and position; pairs of the same set are none."""
    n, i, s = x["n"], x["i"], x["s"]
    both, share = n[a] + n[b], similarity / (1 + similarity)
    differ = np.bitwise_count(x["bits"][a] ^ x["bits"][b]).astype(np.int64) + np.bitwise_count(x["more"][a] ^ x["more"][b])
    keep = differ <= both * (1 - 2 * share) + 1e-9
    a, b, both = a[keep], b[keep], both[keep]
    need = np.ceil(share * both - 1e-9)
    keep = (np.minimum(n[a] - i[a], n[b] - i[b]) >= need) & (n[b] >= similarity * n[a] - 1e-9) & (n[a] >= similarity * n[b] - 1e-9) & (s[a] != s[b])
    return a[keep], b[keep]


def compared(x: dict[str, np.ndarray], similarity: float, near: int, cut: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (a, b) of sets among key rows, and which rows (of x, put in order) are of a key that is not paired out: all
    if cut, else those of keys where a set has more than ``near`` smaller sets of fitting size, or more than FEW candidates."""
    at = lambda size: (x["key"].astype(np.uint64) << np.uint64(32)) | size.astype(np.uint64)
    # of a key's rows of one set, sent from several lots of lines, only the first by place stays
    own = x["s"].view(np.uint64) + mixed(x["i"].astype(np.uint64))
    sizes = at(x["n"])
    order = np.lexsort((x["place"], own, sizes))
    sizes, own = sizes[order], own[order]
    order = order[np.append(True, (sizes[1:] != sizes[:-1]) | (own[1:] != own[:-1]))[: len(order)]]
    for name in x:
        x[name] = x[name][order]
    x["n"], x["i"] = x["n"].astype(np.int64), x["i"].astype(np.int64)
    n, rows = x["n"], np.arange(len(x["n"]))
    # the largest partner that a row's position allows; rows that allow none of their own size are no smaller partners
    most = np.floor((n - x["i"]) * (1 + similarity) / similarity - n + 1e-9).astype(np.int64)
    smaller = np.flatnonzero(most >= n)
    sizes = at(n)[smaller]
    low = np.searchsorted(sizes, at(np.ceil(similarity * n - 1e-9)))
    high = np.searchsorted(sizes, at(np.maximum(np.minimum(n, most), 0)), "right")
    counts = np.maximum(high - low, 0)
    hot = rows if cut else rows[counts > near]
    counts = np.minimum(counts, 0 if cut else near)
    found = [(np.zeros(0, np.int64),) * 2]
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(rows):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + ROWS, "right")))
        c = counts[begin:end]
        b = np.repeat(high[begin:end] - c, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        a, b = could(x, np.repeat(rows[begin:end], c), smaller[b], similarity)
        # those before it first, the most alike of them first
        differ = np.bitwise_count(x["bits"][a] ^ x["bits"][b]) + np.bitwise_count(x["more"][a] ^ x["more"][b])
        order = np.lexsort((differ, x["place"][b] > x["place"][a], a))
        a, b = a[order], b[order]
        most = np.arange(len(a)) - np.searchsorted(a, a) >= FEW
        hot = np.append(hot, a[most])
        found.append((a[~most], b[~most]))
        begin = end
    hot = np.flatnonzero(np.isin(x["key"], x["key"][hot]))
    if len(hot):  # the first set of each key by place
        by = hot[np.lexsort((x["place"][hot], x["key"][hot]))]
        new = np.append(True, x["key"][by][1:] != x["key"][by][:-1])
        found.append(could(x, by, by[np.flatnonzero(new)][np.cumsum(new) - 1], similarity))
    a, b = (np.concatenate(c) for c in zip(*found, strict=True))
    a, b = x["s"][a], x["s"][b]
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return a[new], b[new], hot


def met(rows: DataFrame, similarity: float, near: int = NEAR, lot: int = LOT) -> DataFrame:
    """Arrays of signatures(), together by kind and bucket, to rows (kind, key, a, b, n, i, bits, more, line): for KEYS candidate pairs
    of sets (a, b), or with a key the rows a, at place b, of a key with more than ``near`` sets; for SETS the first place (b, line) of set a;
    for GONE the places (b, line) of lines whose set comes before."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

        def table(kind, size, **columns):
            made = [pa.array(np.full(size, kind, np.int32)) if name == "kind" else pa.array(columns[name], t) if name in columns else pa.nulls(size, t) for name, t in zip(names, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(made, names)

        names = ["kind", "key", "a", "b", "n", "i", "bits", "more", "line"]

        def close(kind: int, bucket: int, parts: list[bytes], cut: bool):
            if kind == KEYS:
                x = unpacked(parts, KEY)
                a, b, hot = compared(x, similarity, near, cut)
                yield table(KEYS, len(a), a=a, b=b)
                if len(hot):
                    yield table(KEYS, len(hot), key=(np.int64(bucket) << 32) | x["key"][hot].astype(np.int64), a=x["s"][hot], b=x["place"][hot].astype(np.int64), n=x["n"][hot], i=x["i"][hot], bits=x["bits"][hot].view(np.int64), more=x["more"][hot].view(np.int64))
            else:
                x = unpacked(parts, SET)
                gone = np.arange(len(x["s"]))
                if kind == SETS:
                    order = np.lexsort((x["line"], x["doc_id"], x["s"]))
                    x = {name: c[order] for name, c in x.items()}
                    new = np.append(True, x["s"][1:] != x["s"][:-1])
                    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                    gone = np.flatnonzero((x["doc_id"] > x["doc_id"][lead]) | (x["line"] > x["line"][lead]))
                    new = np.flatnonzero(new)
                    yield table(SETS, len(new), a=x["s"][new], b=x["doc_id"][new], line=x["line"][new])
                yield table(GONE, len(gone), b=x["doc_id"][gone], line=x["line"][gone])

        now, parts, size, cut = None, [], 0, False
        for batch in batches:
            for kind, bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a range of more rows than fit is compared in lots, and all its keys go on to the full join
                full = kind == KEYS and size + len(data) > lot * WIDTH
                if parts and (full or (kind, bucket) != now):
                    cut = cut or full
                    yield from close(*now, parts, cut)
                    parts, size, cut = [], 0, cut and (kind, bucket) == now
                now = (kind, bucket)
                parts.append(data)
                size += len(data)
        if parts:
            yield from close(*now, parts, cut)

    return rows.mapInArrow(run, "kind int, key long, a long, b long, n int, i int, bits long, more long, line int")


def verified(docs: DataFrame, pairs: DataFrame, firsts: DataFrame, similarity: float) -> DataFrame:
    """(s, doc_id, line): of pairs (a, b) of sets with similar words, the one whose first place comes later; the lines are read from their texts."""
    wanted = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct().join(firsts, "s")
    # wanted grows with the corpus: a merge join at every size, no broadcast
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line", "s")).alias("own")).hint("merge")

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            doc, no, sets, words = [], [], [], []
            for d, text, own in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = (text or b"").split(b"\n")
                for x in own:
                    if x["line"] < len(parts):
                        doc.append(d)
                        no.append(x["line"])
                        sets.append(x["s"])
                        own_words = set(parts[x["line"]].lower().split())
                        words.append(np.fromiter(map(xxhash.xxh64_intdigest, own_words), np.uint64, len(own_words)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(words, pa.list_(pa.int64()))], ["s", "doc_id", "line", "words"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = stage(texts.join(wanted, "doc_id").select("doc_id", "text", "own").mapInArrow(run, "s long, doc_id long, line int, words array<long>"), "words")
    side = lambda k: words.select(F.col("s").alias(k), F.struct("doc_id", "line").alias(f"at_{k}"), F.col("words").alias(f"words_{k}"))
    shared = F.size(F.array_intersect("words_a", "words_b"))
    near = (shared >= similarity * (F.size("words_a") + F.size("words_b") - shared) - 1e-9) & (F.col("at_a") != F.col("at_b"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(near)
    later = F.when(F.col("at_a") > F.col("at_b"), F.struct(F.col("a").alias("s"), F.col("at_a").alias("at"))).otherwise(F.struct(F.col("b").alias("s"), F.col("at_b").alias("at")))
    found = stage(both.select(later.alias("x")).select("x.s", "x.at.doc_id", "x.at.line").distinct(), "found")
    release(words)
    return found


def removed(docs: DataFrame, similarity: float = 0.8, near: int = NEAR, lot: int = LOT) -> DataFrame:
    """(doc_id, lines array<int>): numbers, from 0, of the lines that go, for documents that lose any.

    Lines without a word stay. A null doc_id comes before all others; lines at the same place of rows that repeat a doc_id count
    as one line. A null text has no lines that could go. An empty table gives an empty result. A very long text is handled in
    lots of lines, a very long line whole.
    """
    levels, total = rarity(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = signatures(docs, levels, total, similarity, min(parts * FINE, 1 << 16)).repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    found = stage(met(rows, similarity, near, lot), "met")
    gone = found.where(F.col("kind") == GONE).select(F.col("b").alias("doc_id"), "line")
    firsts = found.where(F.col("kind") == SETS).select(F.col("a").alias("s"), F.col("b").alias("doc_id"), "line")
    pairs = stage(found.where((F.col("kind") == KEYS) & F.col("key").isNull()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    similar = verified(docs, pairs, firsts, similarity)
    gone = gone.union(similar.select("doc_id", "line"))

    members = found.where("key is not null").select("key", F.col("a").alias("s"), F.col("b").alias("place"), "n", "i", "bits", "more")
    if not members.isEmpty():
        # a set is held against those before its first place; keys compared in lots may have it more than once
        a = members.join(similar, "s", "left_anti").groupBy("key", "s", "n", "i", "bits", "more").agg(F.min("place").alias("place")).alias("a")
        b = members.alias("b")
        could = F.expr(f"""a.key = b.key and b.place <= a.place and a.s <> b.s and b.n >= {similarity} * a.n - 1e-9 and a.n >= {similarity} * b.n - 1e-9
            and bit_count(a.bits ^ b.bits) + bit_count(a.more ^ b.more) <= a.n + b.n - 2 * ceil({similarity} / (1 + {similarity}) * (a.n + b.n) - 1e-9)
            and least(a.n - a.i, b.n - b.i) >= ceil({similarity} / (1 + {similarity}) * (a.n + b.n) - 1e-9)""")
        more = a.join(b, could).select(F.least("a.s", "b.s").alias("a"), F.greatest("a.s", "b.s").alias("b")).distinct()
        more = stage(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
        gone = gone.union(verified(docs, more, firsts, similarity).select("doc_id", "line"))
    out = stage(gone.distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("lines")), "removed")
    release(found, pairs)
    return out


def dedup(docs: DataFrame, similarity: float = 0.8, out: str = "lines") -> DataFrame:
    """docs with text without the lines that go, and a struct ``out`` (n_lines, removed); where docs has a column of that name, ``out`` gets
    an underscore more. Other columns stay as they are."""
    out, key = free(docs, out), free(docs, "_doc")
    gone = removed(docs, similarity).select(F.col("doc_id").alias(key), F.col("lines").alias(f"{key}_gone"))
    rows = docs.join(gone.hint("merge"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL)) == gone[key], "left").drop(key)
    lost = F.col(f"{key}_gone")
    parts = F.split(F.col("text").cast("string"), "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(lost, i)), "\n")
    told = F.struct(F.coalesce(F.size(parts).cast("long"), F.lit(0)).alias("n_lines"), F.coalesce(lost, F.expr("cast(array() as array<int>)")).alias("removed"))
    return rows.withColumns({out: told, "text": F.when(lost.isNull(), F.col("text")).otherwise(kept)}).select(*docs.columns, out)


def cleaned(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs with the lines that go taken out of text; the same columns."""
    return dedup(docs, similarity).select(*docs.columns)
