"""Target-distribution importance resampling: documents whose n-grams are likelier in a target text are drawn first.

Words are laid out in a table by position; the window function lead() puts the following words of the same document beside each,
so a row has the n-grams of every order that begin at its word. Each n-gram's hash names a bucket, a bucket's gain is the log ratio
of its shares of the target and of the corpus, and a document's weight is the sum of its n-grams' gains. With Gumbel noise on the
weights the highest scores are a draw without replacement, in proportion to the likelihood ratios.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import release, stage
from quillon.llm.terms import ascii_lower, duck_words, ranked, split_words

BUCKETS, ORDERS = 10_000, 3


def ngram_buckets(docs: DataFrame, key: str = "doc_id", text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(row, key, b1, b2, ...): one row for each word, with the bucket of the n-gram of each order that begins there, null where the text ends before.

    A text without words (null, empty, no letters) has one row of nulls. ``row`` tells rows of docs apart, equal ones too. Whole
    texts are dealt out by row once; word rows are never shuffled, and a long text's window spills where it must.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")).repartition("row")
    words = rows.select("row", "key", F.posexplode_outer(split_words(F.col("text"))).alias("pos", "word"))
    words = words.withColumn("word", ascii_lower(F.col("word")))
    following = Window.partitionBy("row").orderBy("pos")
    nexts = [F.col("word"), *(F.lead("word", k).over(following) for k in range(1, orders))]
    laid = words.select("row", "key", *[x.alias(f"w{k + 1}") for k, x in enumerate(nexts)])
    gram = lambda k: reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.col(f"w{j + 1}") for j in range(k)])
    return laid.select("row", "key", *[(F.crc32(gram(k).cast("binary")) % buckets).cast("int").alias(f"b{k}") for k in range(1, orders + 1)])


def bucket_counts(laid: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(bucket, n): how many n-grams each bucket holds; at most one row for each bucket."""
    each = laid.select(F.explode(F.array(*[f"b{k}" for k in range(1, orders + 1)])).alias("bucket"))
    return each.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), from the bucket counts of both sides.

    The two totals pass the driver; the table has as many rows as there are buckets."""
    spark = corpus.sparkSession
    total = lambda df: float(df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    S, T = total(corpus), total(target)
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    one = lambda c: F.col(c).cast("double") + 1.0
    return both.select("bucket", F.floor(1000.0 * F.ln(one("t") * F.lit(S + buckets) / (one("s") * F.lit(T + buckets)))).alias("gain"))


def weighted(laid: DataFrame, gain: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(key, n_words, n_features, weight) of each document: its n-grams meet the gains, a broadcast of one row a bucket, and are summed."""
    columns = [f"b{k}" for k in range(1, orders + 1)]
    for c in columns:
        laid = laid.join(F.broadcast(gain.select(F.col("bucket").alias(c), F.col("gain").alias(f"g_{c}"))), c, "left")
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    sums = laid.groupBy("row", "key").agg(
        F.count("b1").alias("n_words"),
        add([F.count(c) for c in columns]).alias("n_features"),
        F.sum(add([F.coalesce(f"g_{c}", F.lit(0)) for c in columns])).alias("weight"),
    )
    return sums.select("key", "n_words", "n_features", "weight")


def noise(key, seed: int = 42):
    """Gumbel noise in thousandths from the first 32 bits of a hash of seed and key; a null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def importance(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of docs; rank is null for those not drawn.

    Drawn are floor(percent * N / 100) of the N documents with at least ``least_words`` words, highest scores first, equal ones by
    ascending key. A null or empty text has no words, weight 0 and is never drawn; a null key comes after the others of its
    score; rows that repeat a key are documents of their own. With an empty target all gains come from the corpus alone; an empty
    table gives no rows. Other columns are not read.
    """
    laid = stage(ngram_buckets(docs, key, text), "buckets")
    wanted = bucket_counts(ngram_buckets(target, target.columns[0], text))
    gain = stage(gains(stage(bucket_counts(laid), "corpus"), stage(wanted, "target")), "gains")
    found = weighted(laid, gain).withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    found = stage(found.withColumn("able", F.col("n_words") >= least_words), "scores")
    release(laid)
    drawn = percent * found.where("able").count() // 100
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("key"), F.desc("weight"), F.desc("n_features")]
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked(found, *order).select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", rank.alias("rank"))


def drawn(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs that importance() has drawn, all columns as they are; a key that repeats stays with all its rows if one is drawn."""
    return docs.join(found.where("rank is not null").select(key).distinct(), docs[key].eqNullSafe(found[key]), "left_semi")


# The twin: crc32 by its table, made bit by bit, over the bytes of each distinct n-gram.
SQL = f"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT 's' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT side, r, doc_id, {duck_words("text")} AS w FROM texts),
pos AS (SELECT side, r, w, unnest(range(1, len(w) + 1)) AS p FROM words),
grams AS (
  SELECT side, r, w[p] AS g FROM pos UNION ALL SELECT side, r, w[p] || ' ' || w[p + 1] FROM pos WHERE p + 1 <= len(w)
  UNION ALL SELECT side, r, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] FROM pos WHERE p + 2 <= len(w)),
counted AS (SELECT side, r, g, count(*) AS n FROM grams GROUP BY ALL),
names AS (SELECT DISTINCT g, hex(encode(g)) AS h FROM counted),
hashed AS (
  SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 10000 AS bucket FROM names, tab),
fitted AS (SELECT side, r, n, bucket FROM counted JOIN hashed USING (g)),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM fitted GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS S_, sum(t)::DOUBLE AS T_ FROM counts),
gain AS (SELECT bucket, floor(1000.0 * ln((t::DOUBLE + 1.0) * (S_ + 10000) / ((s::DOUBLE + 1.0) * (T_ + 10000))))::BIGINT AS gain FROM counts, totals),
sums AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM fitted JOIN gain USING (bucket) WHERE side = 's' GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000.0 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM words LEFT JOIN sums USING (r) WHERE side = 's'),
placed AS (SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id) AS k, count(*) FILTER (n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 5 * able // 100 THEN k END AS rank FROM placed"""
