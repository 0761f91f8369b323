"""Ranked lexical search of many items over all documents, as a blocked product of sparse matrices in whole numbers.

The left matrix has a row for each item, with the multiplicity of its terms; the right one a row for each term, with an int64 impact
for each document that holds it. Documents stand in blocks, each with its part of the right matrix in compressed rows, made where
their texts are read; nothing is shuffled by term, so a frequent term is no hot key. An item meets a block by merging the rows of
its terms into one vector of scores (Gustavson's order), of which only the k best leave; the best of blocks are reduced in tasks,
then over parts of the documents, then over all.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import arrow_bytes, release, stage
from quillon.llm.terms import byte_words, duck_words

#: Postings of a block of documents, term places of a block of items, bytes of items that may be broadcast, candidates held in a task.
POSTINGS, PLACES, BROADCAST, HELD = 1 << 17, 1 << 18, 8 << 20, 1 << 20
#: Blocks that a task holds while their table is written or read.
AT_ONCE = 4
BLOCK = "docs array<long>, lens array<long>, terms array<string>, ptr array<int>, doc array<int>, tf array<int>"


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents of at least POSTINGS postings (a partition's last may have fewer): their keys, numbers of terms and their postings, sorted by term.

    ``doc[ptr[t]:ptr[t + 1]]`` and ``tf`` of the same places are the documents of ``terms[t]``, as places in ``docs``, and its
    frequencies there. Texts without terms stand in the block, with length 0. A text is in one block, whole."""

    def run(batches):
        import pyarrow as pa

        def row(ids, lens, index, codes, tfs, sizes):
            code, tf = np.concatenate(codes), np.concatenate(tfs)
            order = np.argsort(code, kind="stable")
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]
            ptr = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(index)))]).astype(np.int32)
            cells = [(ids, pa.int64()), (lens, pa.int64()), ([x.decode() for x in index], pa.string()), (ptr, pa.int32()), (doc, pa.int32()), (tf[order].astype(np.int32), pa.int32())]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for x, t in cells]
            return pa.RecordBatch.from_arrays(lists, ["docs", "lens", "terms", "ptr", "doc", "tf"])

        fresh = lambda: ([], [], defaultdict(count().__next__), [], [], [])
        held, n = fresh(), 0
        for batch in batches:
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, lens, index, codes, tfs, sizes = held
                words = byte_words(body.as_py())
                code, tf = np.unique(np.fromiter(map(index.__getitem__, words), np.int64, len(words)), return_counts=True)
                for to, x in zip(held, (own, len(words), None, code, tf, len(code)), strict=True):
                    if to is not index:
                        to.append(x)
                n += len(code)
                if n >= POSTINGS:
                    yield row(*held)
                    held, n = fresh(), 0
        if held[0]:
            yield row(*held)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string").cast("binary")).mapInArrow(run, BLOCK)


def item_terms(items: DataFrame, key: str, text: str, repeats: bool = False) -> DataFrame:
    """(item, key, term, times): the distinct terms of each row of items, which ``item`` tells apart; times is 1, or how often the term occurs."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            item, ids, terms, times = [], [], [], []
            for row, own, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                found: dict[bytes, int] = {}
                for x in byte_words(body):
                    found[x] = found.get(x, 0) + 1 if repeats else 1
                item += [row] * len(found)
                ids += [own] * len(found)
                terms += [x.decode() for x in found]
                times += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(times, pa.int64())], ["item", "key", "term", "times"])

    rows = items.select(F.monotonically_increasing_id(), F.col(key).cast("long"), F.col(text).cast("string").cast("binary"))
    return rows.mapInArrow(run, "item long, key long, term string, times long")


def weights(index: DataFrame, asked: DataFrame, n_docs: int) -> DataFrame:
    """(term, w) of the items' terms that some document holds: floor(1000 ln((2N + 2) / (2 df + 1))). Blocks have counted their documents before the shuffle."""
    sizes = F.zip_with(F.slice("ptr", F.lit(2), F.size("terms")), F.slice("ptr", F.lit(1), F.size("terms")), lambda a, b: a - b)
    each = index.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), sizes.alias("df"))).alias("x")).select("x.term", "x.df")
    counts = each.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    return counts.select("term", F.floor(1000.0 * F.ln(F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).alias("w"))


def product(rows: DataFrame, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """(item, key, doc, score): of each block of documents and block of items standing in one row, and of the blocks of a task, the k best documents of each item."""

    def cut(held):
        """(item, doc, null, score): the k best of each item, equal scores by ascending document, null last."""
        item, doc, null, score = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, null, -score, item))
        ordered = item[order]
        keep = order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]
        return item[keep], doc[keep], null[keep], score[keep]

    def run(batches):
        import pyarrow as pa

        def made(cells):
            item, doc, null, score = cells
            own = pa.array([keys[x] for x in item.tolist()], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(item), own, pa.array(doc, mask=null), pa.array(score)], ["item", "key", "doc", "score"])

        held, n, keys = [], 0, {}
        for batch in batches:
            at = {name: batch.column(j) for j, name in enumerate(batch.schema.names)}
            for j in range(batch.num_rows):
                cell = lambda name: at[name][j].values  # noqa: B023, E731
                docs, lens = cell("docs"), cell("lens").to_numpy()
                null, docs = docs.is_null().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
                ptr, doc, tf = (cell(x).to_numpy() for x in ("ptr", "doc", "tf"))
                code = {x: c for c, x in enumerate(cell("terms").to_pylist())}
                m = 100 - 50 + (50 * lens * n_docs) // max(1, n_terms)
                impact = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m[doc])
                total = np.zeros(len(lens), np.int64)
                for asked in cell("items").to_pylist():
                    total[:] = 0
                    for x in asked["terms"]:
                        if (c := code.get(x["term"])) is not None:
                            part = slice(ptr[c], ptr[c + 1])
                            total[doc[part]] += x["w"] * impact[part]  # a term's documents differ, so no place is met twice
                    good = np.flatnonzero(total > 0)
                    if len(good) > k:
                        good = good[total[good] >= np.partition(total[good], len(good) - k)[len(good) - k]]
                    if len(good):
                        keys[asked["item"]] = asked["key"]
                        held.append((np.full(len(good), asked["item"]), docs[good], null[good], total[good]))
                        n += len(good)
                if n > HELD:
                    held = [cut(held)]
                    n = len(held[0][0])
                    if 2 * n > HELD:
                        yield made(held[0])
                        held, n, keys = [], 0, {}
        if held:
            yield made(cut(held))

    return rows.mapInArrow(run, "item long, key long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", item_key: str = "item_id", text: str = "text", repeats: bool = False) -> DataFrame:
    """(item_key, rank, key, score): the k documents with the highest scores above 0 of each item, equal scores by ascending key.

    A score sums w * ((10^9 tf) div (1000 tf + 20 m)) over the item's terms, with m = 50 + ((50 n N) div L); with ``repeats`` a term
    counts as often as the item has it. A null or empty text has no terms: as a document it is found by no item, as an item it
    finds nothing. Rows that repeat a key are documents or items of their own; a null key comes last among equal scores. Empty
    tables give no rows. Other columns are not read. Items are broadcast up to BROADCAST bytes; beyond, blocks of items and
    blocks of documents meet in a merge join over salted keys.
    """
    spark = docs.sparkSession
    with arrow_bytes(spark):
        index = stage(blocks(docs, key, text), "blocks", AT_ONCE)
    asked = stage(item_terms(items, item_key, text, repeats), "items")
    n_blocks, n_docs, n_terms = index.select(F.size(F.filter("lens", lambda x: x > 0)).alias("n"), F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    places, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term") + 24), F.lit(0))).first()
    n_parts = max(1, -(-places // PLACES))
    terms = asked.join(weights(index, asked, n_docs), "term").where("w > 0").groupBy("item", "key")
    lists = terms.agg(F.sort_array(F.collect_list(F.struct("term", (F.col("w") * F.col("times")).alias("w")))).alias("terms"))
    lists = lists.groupBy(F.pmod(F.xxhash64("item"), F.lit(n_parts)).cast("int").alias("part")).agg(F.sort_array(F.collect_list(F.struct("item", "key", "terms"))).alias("items"))
    lists = stage(lists, "lists")
    rows = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    if size <= BROADCAST:
        rows = rows.join(F.broadcast(lists), "part")
    else:
        salts = max(1, n_blocks // 8)
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("docs"), F.lit(salts)).cast("int"))
        rows = rows.join(lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge"), ["part", "salt"])
    best = product(rows.select(*index.columns, "items"), k, n_docs, n_terms)
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    for by in (["item", F.pmod(F.xxhash64("doc"), F.lit(64))], ["item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    with arrow_bytes(spark):
        best = stage(best, "best")
    release(index, lists, asked)
    return best.select(F.col("key").alias(item_key), "rank", F.col("doc").alias(key), "score")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {duck_words("text")} AS w FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, list_distinct({duck_words("text")}) AS w FROM benchmark),
size AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
asked AS (SELECT i, item_id, unnest(w) AS term FROM i),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
wt AS (SELECT term, floor(1000.0 * ln((2.0::DOUBLE * n_docs + 2.0) / (2.0::DOUBLE * count(*) + 1.0)))::BIGINT AS w FROM tf, size GROUP BY term, n_docs),
impact AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))) AS x FROM tf JOIN wt USING (term), size),
score AS (SELECT i, item_id, r, doc_id, sum(x)::BIGINT AS score FROM asked JOIN impact USING (term) GROUP BY ALL HAVING sum(x) > 0)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM score QUALIFY rank <= 50"""
