"""Retrieval over tables: keyword scores, vector scores, fusion, caps and grouping, for many questions at once."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.session import kept, spread

K1, B = 1.2, 0.75


def term_table(docs: DataFrame, key: str, text: str, terms: list[str], prefix_from: int = 5) -> DataFrame:
    """(key, len, tf_0, tf_1, ...): document length in words and each term's frequency; one pass.

    A term of at least ``prefix_from`` letters also counts words that it begins."""
    test = lambda t: (lambda x: x.startswith(t)) if len(t) >= prefix_from else (lambda x: x == t)
    count = lambda w: F.array(F.size(w), *[F.size(F.filter(w, test(t))) for t in terms])
    found = spread(docs.select(key, text)).select(key, tx.once(tx.tokens(tx.normalize(F.col(text))), count).alias("n"))
    # narrow, and read twice: for the statistics and for the scores
    return kept(found.select(key, F.col("n")[0].alias("len"), *[F.col("n")[k + 1].alias(f"tf_{k}") for k in range(len(terms))]), "terms")


def bm25(table: DataFrame, key: str, n_terms: int, weights: list[float] | None = None) -> DataFrame:
    """(key, score) of the documents with a hit: sum of w * ln(1 + (N - n + .5) / (n + .5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len / mean len)).

    The statistics are one row; they meet the documents in a broadcast of that row."""
    weights = weights or [1.0] * n_terms
    stats = table.agg(F.count("*").alias("N"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf_{k}") > 0).alias(f"n_{k}") for k in range(n_terms)])
    parts = []
    for k, w in enumerate(weights):
        f, n = F.col(f"tf_{k}"), F.col(f"n_{k}")
        idf = F.lit(w) * F.ln(1 + (F.col("N") - n + 0.5) / (n + 0.5))
        parts.append(idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean"))))
    scored = table.crossJoin(F.broadcast(stats)).select(key, reduce(lambda a, b: a + b, parts).alias("score"))
    return scored.where("score > 0")


def coverage(table: DataFrame, key: str, n_terms: int) -> DataFrame:
    """(key, coverage): share of the question's idf whose words occur; a word found nowhere weighs nothing."""
    stats = table.agg(F.count("*").alias("N"), *[F.count_if(F.col(f"tf_{k}") > 0).alias(f"n_{k}") for k in range(n_terms)])
    idf = [F.when(F.col(f"n_{k}") > 0, F.ln(1 + (F.col("N") - F.col(f"n_{k}") + 0.5) / (F.col(f"n_{k}") + 0.5))).otherwise(F.lit(0.0)) for k in range(n_terms)]
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    total = add(idf)
    got = add([F.when(F.col(f"tf_{k}") > 0, x).otherwise(F.lit(0.0)) for k, x in enumerate(idf)])
    return table.crossJoin(F.broadcast(stats)).select(key, (got / F.when(total == 0, F.lit(1.0)).otherwise(total)).alias("coverage"))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cut_vector(v: Column, size: int) -> Column:
    """The first ``size`` numbers, scaled to length 1 again; a zero vector stays."""
    part = F.transform(F.slice(v, 1, size), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(part, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def nearest(queries: DataFrame, vectors: DataFrame, n: int, held: int = 32768, lot: int = 4096) -> DataFrame:
    """Exact top n of ``vectors`` (vec_id, v) for each of ``queries`` (query_id, q): (query_id, vec_id, cosine, rank); a vector is not its own neighbour.

    Tiles of a block of queries and a part of the vectors, a task each: it holds its queries, at most about ``held``, and the best n of
    each, while the vectors pass it by lots. So no pair is a row, and n rows of a query leave a tile. As many vectors as questions are sent
    about so often as the square root of the tasks. A matrix product in single precision only tells which pairs come into question, by its
    bound of error; their cosines are summed in order in double precision, as SQL does, so equal vectors tie and smaller ids win."""
    tiles, n_q, n_v = 2 * queries.sparkSession.sparkContext.defaultParallelism, queries.count(), max(1, vectors.count())
    blocks = max(1, -(-n_q // held), min(tiles, round(math.sqrt(3 * tiles * n_q / n_v))))
    parts = -(-tiles // blocks)
    of = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = queries.select(F.lit(0).alias("side"), F.col("query_id").cast("long").alias("id"), F.col("q").alias("v"), of("query_id", blocks).alias("block"), every(parts).alias("part"))
    given = vectors.select(F.lit(1).alias("side"), F.col("vec_id").cast("long").alias("id"), "v", every(blocks).alias("block"), of("vec_id", parts).alias("part"))
    dealt = asked.unionByName(given).repartitionById(blocks * parts, (F.col("block") * parts + F.col("part")).cast("int")).select("side", "id", "v").sortWithinPartitions("side")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def side(batch, k):
            rows = batch.filter(pa.array(np.asarray(batch.column("side")) == k))
            return np.asarray(rows.column("id")), np.asarray(rows.column("v").flatten(), float).reshape(rows.num_rows, -1) if rows.num_rows else np.empty((0, 0))

        def prepared(v):
            norm = np.sqrt((v * v).sum(1))
            plain = np.isfinite(norm).all() and ((norm == 0) | (norm > 1e-9) & (norm < 1e9)).all()  # else single precision may over- or underflow
            return norm, plain

        def meet(a, b, vi, v, v_norm, kind):
            """Bring the best of queries a to b up to date by vectors v."""
            error = 4 * (v.shape[1] + 8) * float(np.finfo(kind).eps) * norm[a:b] * v_norm.max()
            cosine, least = q[a:b].astype(kind) @ v.astype(kind).T, top[a:b, -1].copy()
            new = least == -np.inf
            if new.any() and v.shape[0] > n:
                cosine[qi[a:b, None] == vi[None, :]] = -np.inf
                least[new] = np.partition(cosine[new], -n, axis=1)[:, -n]
            rows, cols = np.divmod(np.flatnonzero(cosine >= (least - error).astype(kind)[:, None]), len(vi))
            for k in range(0, len(rows), 1 << 16):
                take(a + rows[k : k + (1 << 16)], vi, v, cols[k : k + (1 << 16)])

        def take(rows, vi, v, cols):
            exact, ids = np.cumsum(q[rows] * v[cols], axis=1)[:, -1], vi[cols]
            keep = (ids != qi[rows]) & ((exact > top[rows, -1]) | (exact == top[rows, -1]) & (ids < own[rows, -1]))
            if not keep.any():
                return
            u = np.unique(rows[keep])
            rows = np.concatenate([np.repeat(u, n), rows[keep]])
            ids, exact = np.concatenate([own[u].ravel(), ids[keep]]), np.concatenate([top[u].ravel(), exact[keep]])
            order = np.lexsort((ids, -exact, rows))
            at = np.searchsorted(rows[order], u)[:, None] + np.arange(n)
            own[u], top[u] = ids[order][at], exact[order][at]

        held_, qi = [], None
        for batch in batches:
            if (x := side(batch, 0))[0].size:
                held_.append(x)
            vi, v = side(batch, 1)
            if not vi.size or not held_:
                continue
            if qi is None:
                qi, q = np.concatenate([x[0] for x in held_]), np.concatenate([x[1] for x in held_])
                norm, q_plain = prepared(q)
                own, top = np.full((len(qi), n), np.iinfo(np.int64).max), np.full((len(qi), n), -np.inf)
            for k in range(0, len(vi), lot):
                v_norm, v_plain = prepared(v[k : k + lot])
                for a in range(0, len(qi), 1024):
                    meet(a, min(a + 1024, len(qi)), vi[k : k + lot], v[k : k + lot], v_norm, np.float32 if q_plain and v_plain else np.float64)
        for a in range(0, len(qi) if qi is not None else 0, 1024):
            keep = (top[a : a + 1024] > -np.inf).ravel()
            cols = np.repeat(qi[a : a + 1024], n)[keep], own[a : a + 1024].ravel()[keep], top[a : a + 1024].ravel()[keep]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["query_id", "vec_id", "cosine"])

    near = dealt.mapInArrow(run, "query_id long, vec_id long, cosine double")
    return cap(near, "query_id", n, F.desc("cosine"), "vec_id")


def fuse(vector: DataFrame, words: DataFrame, key: str, word_weight: float = 0.5, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (key, rank): (key, vrank, wrank, rrf)."""
    both = vector.select(key, F.col("rank").alias("vrank")).join(words.select(key, F.col("rank").alias("wrank")), key, "full_outer")
    score = F.coalesce(1 / (k + F.col("vrank")), F.lit(0.0)) + F.coalesce(F.lit(word_weight) / (k + F.col("wrank")), F.lit(0.0))
    return both.withColumn("rrf", score)


def cap(df: DataFrame, by: str, n: int, *order) -> DataFrame:
    """The first n rows of each ``by`` in the given order, with ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def interleave(lists: DataFrame, key: str, n: int) -> DataFrame:
    """Round robin of ranked lists (list, rank, key): first places first, each key once, n in all; (position, key)."""
    first = lists.groupBy(key).agg(F.min(F.struct("rank", "list")).alias("at"))
    top = first.orderBy("at.rank", "at.list", key).limit(n)
    return top.select(F.row_number().over(Window.orderBy("at.rank", "at.list", key)).alias("position"), key)


def weighted_bm25(df: DataFrame, key: str, columns: dict[str, float], terms: list[str]) -> DataFrame:
    """(key, score) over several word columns: frequencies are weighted by column, lengths are not, idf is at least 1e-6."""
    n = lambda c, t: F.size(F.filter(c, lambda x: x == t))
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    rows = df.select(key, add([F.size(c) for c in columns]).alias("len"), *[add([F.lit(w) * n(c, t) for c, w in columns.items()]).alias(f"tf_{k}") for k, t in enumerate(terms)])
    stats = rows.agg(F.count("*").alias("N"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf_{k}") > 0).alias(f"n_{k}") for k in range(len(terms))])
    parts = []
    for k in range(len(terms)):
        f, m = F.col(f"tf_{k}"), F.col(f"n_{k}")
        parts.append(F.greatest(F.ln((F.col("N") - m + 0.5) / (m + 0.5)), F.lit(1e-6)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean"))))
    return rows.crossJoin(F.broadcast(stats)).select(key, add(parts).alias("score")).where("score > 0")


def questions(asked: DataFrame, index: DataFrame, n: int, most: int = 10) -> DataFrame:
    """Top n documents of many questions: asked (item_id, asked, term) meets postings (doc_id, term, tf) on the term.

    Score: 100 for each word of the question, one for each hit up to ``most`` a word. A frequent word is split by the skew join."""
    found = asked.join(index, "term").groupBy("item_id", "doc_id").agg(F.max("asked").alias("asked"), F.count("*").alias("n_terms"), F.sum(F.least("tf", F.lit(most))).alias("hits"))
    found = found.withColumn("score", 100 * F.col("n_terms") + F.col("hits"))
    return cap(found, "item_id", n, F.desc("score"), "doc_id")


def contained(rows: DataFrame, words: str, table: DataFrame, expression: str) -> DataFrame:
    """rows x table where all words of an expression are among a row's words; joined on the expression's first word."""
    own = rows.withColumn("_w", F.explode(F.array_distinct(words)))
    return own.join(table.withColumn("_w", F.get(expression, F.lit(0))), "_w").where(F.size(F.array_except(expression, words)) == 0).drop("_w")


def greedy_cover(found: DataFrame, by: list[str], item: str, word: str) -> DataFrame:
    """(by, item): of the items found, in order, those that bring a word that no earlier one has.

    found has a row for each item and word. An item left out brings no word of its own, so an item is taken exactly if it is
    the first one found with one of its words: one aggregation, no pass in order.
    """
    return found.groupBy(*by, word).agg(F.min(item).alias(item)).select(*by, item).distinct()


def grouped(found: DataFrame, by: str, n: int, *order) -> DataFrame:
    """(by, level, passages): the first n results of each group in order; the group's level is its first result's."""
    top = cap(found, by, n, *order)
    passages = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",")
    return top.groupBy(by).agg(F.min_by("level", "rank").alias("level"), passages.alias("passages"))
