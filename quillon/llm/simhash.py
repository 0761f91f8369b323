"""SimHash near-duplicates by the generalised pigeonhole principle (operator 1).

Fingerprints of 64 bits link at ``distance`` or fewer differing bits. The bits are dealt into partitions, correlated ones
together; partition i gets a threshold t_i (-1: unused) with sum(t_i + 1) = distance + 1, so that two fingerprints that link
differ in at most t_i bits of some partition i. A dynamic programme picks the thresholds with the least estimated work: keys to
send and candidates to verify. A threshold t becomes keys by halves: every row sends the values within ceil(t/2) flips, each once,
so two values within t meet at some key.

Candidates of a key are verified where they meet: every member is held against the key's smallest one, which joins most of a large
group of near copies, and in a group of at most SMALL members, as chance makes them, all others against each other; only near pairs
leave. Of a larger group, or one with more than DENSE near pairs a member, the members leave, and then only pairs between different
components of the key are compared.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import components, free, release, stage

#: Bits of a fingerprint; members of a key of which all pairs are compared at once; near pairs a member that leave such a key; pairs that cost as much as a key sent.
BITS, SMALL, DENSE, PAIRS = 64, 4096, 4, 100


def shingle_hashes(text: bytes | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """Hashes of the runs of ``width`` words of a text, lower-cased, repeats included; fewer words are one run, no words none."""
    import xxhash

    words = (text or b"").lower().split()
    one, whole = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([one(whole, seed)] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.array([one(whole[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is set if set in over half of them; no hashes: zero."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8)
        counts += np.unpackbits(part).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0]) if len(hashes) else 0


def text_fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text."""
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every row; a null text counts as empty, whose fingerprint is zero."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = np.array([text_fingerprint(x, width, seed) for x in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(n, 64 x 64 counts of rows with bits i and j set): sums over all rows, 4096 numbers to the driver."""

    def run(batches):
        import pyarrow as pa

        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(np.asarray(batch.column(0)).astype(">i8").view(np.uint8)).reshape(-1, BITS).astype(np.float32)
            total, n = total + (bits.T @ bits), n + len(bits)
        at = np.append(np.arange(BITS * BITS), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["at", "n"])

    rows = dict(fps.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect())
    return rows.get(-1, 0), np.array([rows.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)


def arrange(n: int, counts: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into partitions of even size; each next bit of a partition is the one most correlated with it."""
    p = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs(counts / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        own = [max(free, key=lambda b: (strength[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (strength[b, own].sum(), -b)))
            free.remove(own[-1])
        out.append(sorted(own))
    return out


def keys_of(width: int, t: int) -> int:
    """Keys that a row sends for threshold t in a partition of so many bits."""
    return 0 if t < 0 else sum(comb(width, k) for k in range((t + 1) // 2 + 1))


def allocate(n: int, counts: np.ndarray, parts: list[list[int]], distance: int) -> tuple[list[int], float]:
    """Thresholds, and their estimated work, by dynamic programming over partitions; the estimate of a partition's candidates takes its bits' frequencies."""
    p = np.diag(counts) / max(n, 1)
    cost = []
    for part in parts:
        near = np.zeros(distance + 2)
        near[0] = 1.0
        for q in 2 * p[part] * (1 - p[part]):
            near[1:] = near[1:] * (1 - q) + near[:-1] * q
            near[0] *= 1 - q
        cost.append([0.0] + [n * keys_of(len(part), t) + n * n / 2 * near[: t + 1].sum() / PAIRS for t in range(distance + 1)])
    best = {0: (0.0, [])}
    for own in cost:
        step = {}
        for used, (c, ts) in best.items():
            for give in range(distance + 2 - used):
                if (new := c + own[give]) < step.get(used + give, (np.inf,))[0]:
                    step[used + give] = (new, [*ts, give - 1])
        best = step
    return best[distance + 1][1], best[distance + 1][0]


def best_parts(n: int, counts: np.ndarray, distance: int, most: int = 7) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of least estimated work, over the numbers of partitions."""
    options = [(groups, *allocate(n, counts, groups, distance)) for groups in (arrange(n, counts, k) for k in range(2, most + 1))]
    groups, given, _ = min(options, key=lambda x: x[2])
    return groups, given


def keyed(nodes: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(key, node, fp): the rows that meet under a key, a node once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            nodes, whole = (np.asarray(c).astype(np.int64) for c in batch.columns)
            for at in range(0, len(whole), 4096):
                node, fp = nodes[at : at + 4096], whole[at : at + 4096]
                for k, (part, t) in enumerate(zip(parts, thresholds, strict=True)):
                    if t < 0:
                        continue
                    value = np.zeros(len(fp), np.uint64)
                    for j, b in enumerate(part):
                        value |= ((fp.view(np.uint64) >> np.uint64(BITS - 1 - b)) & np.uint64(1)) << np.uint64(j)
                    masks = np.array([sum(1 << x for x in c) for m in range((t + 1) // 2 + 1) for c in combinations(range(len(part)), m)], np.uint64)
                    keys = (value[:, None] ^ masks[None, :]).ravel().view(np.int64)
                    # a partition number in the key: narrow partitions leave room, whole-width ones hash
                    keys = keys + (k << 56) if len(part) <= 48 else keys * np.int64(2 * k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(node, len(masks))), pa.array(np.repeat(fp, len(masks)))], ["key", "node", "fp"])

    return nodes.select("node", "fp").mapInArrow(run, "key long, node long, fp long")


def met(rows: DataFrame, distance: int) -> DataFrame:
    """(key, node, fp, other, led) from rows (key, node, fp) that stand by key and node: near pairs (node, other) with a null key, led if other
    is the key's smallest node; and the members of the keys with more than SMALL of them or with many near pairs, once each, without other."""
    limit = np.uint8(distance)

    def run(batches):
        import pyarrow as pa

        def made(key, node, fp, other, led, pairs: bool):
            n = len(node)
            none = np.ones(n, bool)
            cells = [pa.array(key, pa.int64(), mask=none if pairs else None), pa.array(node), pa.array(fp), pa.array(other, pa.int64(), mask=None if pairs else none), pa.array(led)]
            return pa.RecordBatch.from_arrays(cells, ["key", "node", "fp", "other", "led"])

        def large(lead, key, node, fp):
            """Rows of one large key, and those of them that are near its smallest one."""
            near = (np.bitwise_count((fp ^ lead[2]).view(np.uint64)) <= limit) & (node != lead[1])
            yield made(key, node, fp, node, np.zeros(len(node), bool), False)
            if near.any():
                n = int(near.sum())
                yield made(key[near], node[near], fp[near], np.full(n, lead[1]), np.ones(n, bool), True)

        def whole(key, node, fp):
            """Keys all of whose rows are here."""
            if not len(key):
                return
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(first, append=len(key))
            big = sizes > SMALL
            for a, n in zip(first[big].tolist(), sizes[big].tolist(), strict=True):
                yield from large((key[a], node[a], fp[a]), *(x[a : a + n] for x in (key, node, fp)))
            key, node, fp = (x[np.repeat(~big & (sizes > 1), sizes)] for x in (key, node, fp))
            sizes = sizes[~big & (sizes > 1)]
            if not len(key):
                return
            starts, group = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            at, pairs, n_near = np.arange(len(key)), [], np.zeros(len(sizes), np.int64)
            for step in range(1, int(sizes.max())):
                if step & (step - 1) == 0:  # members that have one so far behind them, of keys that are not dense
                    at = at[(sizes[group[at]] > step) & (n_near[group[at]] <= DENSE * sizes[group[at]])]
                one = at[at + step < (starts + sizes)[group[at]]]
                two = one + step
                near = (np.bitwise_count((fp[one] ^ fp[two]).view(np.uint64)) <= limit) & (node[one] != node[two])
                if near.any():
                    one, two = one[near], two[near]
                    n_near += np.bincount(group[one], minlength=len(sizes))
                    pairs.append((one, two))
            dense = n_near > DENSE * sizes
            for g in np.flatnonzero(dense).tolist():
                a, n = int(starts[g]), int(sizes[g])
                yield from large((key[a], node[a], fp[a]), *(x[a : a + n] for x in (key, node, fp)))
            if pairs:
                one, two = (np.concatenate(x) for x in zip(*pairs, strict=True))
                keep = ~dense[group[one]]
                one, two = one[keep], two[keep]
                yield made(key[one], node[two], fp[two], node[one], one == starts[group[one]], True)

        held, lead = tuple(np.array([], np.int64) for _ in range(3)), None
        for batch in batches:
            now = tuple(np.concatenate([x, np.asarray(c).astype(np.int64)]) for x, c in zip(held, batch.columns, strict=True))
            if lead is not None:
                n = int(np.searchsorted(now[0], lead[0], "right"))
                if n:
                    yield from large(lead, *(x[:n] for x in now))
                now = tuple(x[n:] for x in now)
            if not len(now[0]):
                held = now
                continue
            lead, last = None, int(np.searchsorted(now[0], now[0][-1], "left"))
            yield from whole(*(x[:last] for x in now))
            held = tuple(x[last:] for x in now)
            if len(held[0]) > SMALL:  # a large key's other rows need only its smallest node
                lead = tuple(x[0] for x in held)
                yield from large(lead, *held)
                held = tuple(x[:0] for x in held)
        if len(held[0]):
            yield from whole(*held)

    return rows.mapInArrow(run, "key long, node long, fp long, other long, led boolean")


def linked(nodes: DataFrame, distance: int = 4, parts: int | None = None, known: DataFrame | None = None, verify=None) -> DataFrame:
    """(x, y): links that connect the nodes (node, fp) whose fingerprints differ in at most ``distance`` bits; not every link, but all components.

    verify, if given, maps candidate pairs (x, y) to those that count as links. known are links found before. parts: the number of
    partitions, by default the one with the least estimated work."""
    n, counts = bit_counts(nodes)
    groups, given = best_parts(n, counts, distance) if parts is None else ((g := arrange(n, counts, parts)), allocate(n, counts, g, distance)[0])
    w = Window.partitionBy("key")
    shuffles = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stage(met(keyed(nodes, groups, given).repartition(shuffles, "key").sortWithinPartitions("key", "node"), distance), "met")
    pair = found.where("key is null").select(F.col("node").alias("x"), F.col("other").alias("y"), "led").groupBy("x", "y").agg(F.max("led").alias("led"))
    pair = stage(pair, "near")
    links = pair.where("led").select("x", "y")

    def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs (x, y) of different labels, with these as lx and ly."""
        pairs = pairs.join(labels.select(F.col("node").alias("x"), F.col("label").alias("lx")), "x", "left").join(labels.select(F.col("node").alias("y"), F.col("label").alias("ly")), "y", "left")
        return pairs.select("x", "y", F.coalesce("lx", "x").alias("lx"), F.coalesce("ly", "y").alias("ly")).where("lx <> ly")

    if known is not None:  # pairs of a component need no other link
        labels = stage(components(known, "x", "y"), "labels")
        links = between(links, labels).select("x", "y")
    links = stage(verify(links) if verify else links, "links")
    if known is not None:
        links = links.union(known)
    first = stage(components(links, "x", "y"), "first")
    own = found.where("key is not null").select("key", "node", "fp").join(first, "node", "left").select("key", "node", "fp", F.coalesce("label", "node").alias("label")).distinct()
    own = own.withColumns({"low": F.min("label").over(w), "high": F.max("label").over(w)}).where("low < high")
    own = stage(own.select("key", "node", "fp", "label"), "mixed")
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.label") < F.col("b.label")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance))
    pairs = pairs.select(F.col("a.node").alias("x"), F.col("b.node").alias("y"), F.col("a.label").alias("lx"), F.col("b.label").alias("ly"))
    pairs = pairs.union(between(pair.where("not led").select("x", "y"), first))
    more = verify(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()) if verify else pairs.select(F.col("lx").alias("x"), F.col("ly").alias("y")).distinct()
    more = stage(more, "links")
    release(own, found, pair)
    return first.select(F.col("node").alias("x"), F.col("label").alias("y")).where("x <> y").union(more)


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, distance: int = 4, parts: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id, n_linked) of every row.

    component_id is the smallest doc_id reachable over links; n_linked says how many rows the component has. Null texts and
    texts without a word have fingerprint zero and link like any other. Rows with a null doc_id take part; a component of only
    such rows has a null id. Repeated rows stay repeated. An empty table gives an empty result. Other columns are not read.
    """
    rows = stage(fingerprints(docs, width, seed), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    labels = components(linked(nodes.select(F.col("fp").alias("node"), "fp"), distance, parts), "x", "y").withColumnRenamed("node", "fp")
    named = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    total = named.groupBy("label").agg(F.min("first").alias("component_id"), F.sum("n").alias("n_linked"))
    named = stage(named.join(total, "label").select("fp", "component_id", "n_linked"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "n_linked")


SEEDS = 4


def many_fingerprints(docs: DataFrame, width: int, seeds: int) -> DataFrame:
    """(doc_id, node, fps) of every row: a hash of the lower-cased words, and ``seeds`` fingerprints, each of hashes of its own."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        from quillon.llm.line_dedup import mixed

        for batch in batches:
            nodes, found = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text, width)
                nodes.append(xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split())))
                found += [majority(mixed(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) if k else hashes) for k in range(seeds)]
            fps = pa.FixedSizeListArray.from_arrays(pa.array(np.array(found, np.uint64).view(np.int64)), seeds).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), fps], ["doc_id", "node", "fps"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, node long, fps array<long>")


def verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs (x, y) of nodes whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    owners: (node, doc_id), a row of docs that has the node's text; only texts of these rows are read."""
    pairs = stage(pairs, "pairs")
    wanted = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct().join(owners, "node")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [np.unique(shingle_hashes(x, width)).view(np.int64) for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted.hint("merge"), "doc_id")
    own = stage(own.select("node", "text").dropDuplicates(["node"]).mapInArrow(run, "node long, hashes array<long>"), "compared")
    both = pairs.join(own.select(F.col("node").alias("x"), F.col("hashes").alias("hx")), "x").join(own.select(F.col("node").alias("y"), F.col("hashes").alias("hy")), "y")
    shared = F.size(F.array_intersect("hx", "hy"))
    found = stage(both.where(shared >= similarity * (F.size("hx") + F.size("hy") - shared) - 1e-6).select("x", "y"), "similar")
    release(own, pairs)
    return found


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int = 6, seeds: int = SEEDS) -> DataFrame:
    """docs without the near copies: the row with the smallest doc_id of each component stays; the same columns.

    Candidates are texts of which one of ``seeds`` fingerprints differs in at most ``distance`` bits; they link if their sets of shingles of
    ``width`` words have a Jaccard similarity of ``similarity`` or more, so no other text goes. Texts with the same words are copies, those
    without a word too. A row with a null doc_id stays and takes no other with it, unless the words are the same; rows that repeat a
    doc_id stay or go together. An empty table gives an empty result."""
    rows = stage(many_fingerprints(docs, width, seeds), "fingerprints")
    # a text's owner is the only row that is read for it, so a doc_id that repeats with other texts owns none
    single = rows.groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("doc_id is not null and node = last")
    owners = stage(single.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "owners")
    links = None
    for k in range(seeds):
        nodes = stage(rows.join(owners.select("node"), "node", "left_semi").groupBy("node").agg(F.first(F.col("fps")[k]).alias("fp")), "nodes")
        links = linked(nodes, distance, known=links, verify=lambda pairs: verified(pairs, docs, owners, width, similarity))
        release(nodes)
    named = rows.select("doc_id", "node").join(components(links, "x", "y"), "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("least"))
    gone = stage(named.join(least, "label").where("doc_id <> least").select("doc_id").distinct(), "gone")
    key = free(docs, "_gone")
    return docs.join(gone.withColumnRenamed("doc_id", key).hint("merge"), docs["doc_id"].cast("long") == F.col(key), "left_anti").select(*docs.columns)
