"""Passages of a question in their final order, lines with marks, names in a language's order, manifests whatever their key order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import lexicon as lx
from quillon.functions import marks
from quillon.functions import text as tx
from quillon.functions import values as vl
from quillon.operators import ranking
from quillon.plans.content_queries import sql_list, sql_words
from quillon.plans.registry import query
from quillon.plans.search_queries import SQL_BATCH, batch
from quillon.plans.text_queries import SQL_QUERY_WORDS
from quillon.session import kept, table


def sql_plain(column: str) -> str:
    return f"trim(regexp_replace({tx.sql_normalize(column)}, ' +', ' ', 'g'))"


FIT = "(t = m OR (length(m) >= 5 AND starts_with(t, m)))"
GENERAL = f"regexp_matches({sql_plain('coalesce(section, ' + chr(39) * 2 + ')')}, '^(?:{'|'.join(lx.GENERAL)})(?: |$)')"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four lines of the five best documents of each benchmark item: title is the first line's beginning, section the line's first two words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != ""), 1, 4).alias("l"))
    found = batch(spark, sf_dir).select(F.col("item_id").alias("question"), "doc_id").join(docs, "doc_id")
    rows = found.select("question", "doc_id", F.array_join(F.slice(F.split(F.get("l", F.lit(0)), " "), 1, 3), " ").alias("title"), F.posexplode("l").alias("at", "text"))
    return rows.select("question", (F.col("doc_id") * 4 + F.col("at")).alias("passage"), "title", F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("section"), "text", F.lit(None).cast("string").alias("keys"))


@query(f"""{SQL_BATCH}, line AS (SELECT item_id AS question, doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')[1:4] AS l FROM r JOIN documents USING (doc_id)),
    raw AS (SELECT question, doc_id, array_to_string(string_split(l[1], ' ')[1:3], ' ') AS title, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS at_ FROM line),
    pas AS (SELECT question, doc_id * 4 + at_ AS passage, title, array_to_string(string_split(text, ' ')[1:2], ' ') AS section, text FROM raw),
    qw AS (SELECT item_id AS question, words[1:4] AS words, words[5:6] AS near, words[1] AS term FROM {SQL_QUERY_WORDS}),
    j AS (SELECT pas.*, list_concat(words, near) AS asked, len(words) AS main, term, {sql_words("title || ' ' || section || ' ' || text || ' '")} AS own, {sql_words("section")} AS head, {sql_plain("title")} AS nt FROM pas JOIN qw USING (question) WHERE len(words) > 0),
    k AS (SELECT *, len(own) AS n, list_filter(string_split(nt, ' '), lambda x: x <> '' AND x <> term) AS extras FROM j),
    kind AS (SELECT *, CASE WHEN nt = '' THEN 'none' WHEN nt = term THEN 'exact' WHEN starts_with(nt, term || ' ') AND len(extras) <= 1 THEN 'begins' WHEN contains(nt, term) THEN 'special' ELSE 'none' END AS kind FROM k),
    s AS (SELECT *, avg(n) OVER (PARTITION BY question) AS mean, count(*) OVER (PARTITION BY question) AS docs, max(kind IN ('exact', 'begins')) OVER (PARTITION BY question) AS general FROM kind),
    tf AS (SELECT question, passage, n, mean, docs, main, i, len(list_filter(own, lambda t: t = asked[i] OR (length(asked[i]) >= 5 AND starts_with(t, asked[i])))) AS f FROM (SELECT *, unnest(range(1, len(asked) + 1)) AS i FROM s)),
    idf AS (SELECT *, CASE WHEN i <= main THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * ln(1 + (docs - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT *, count_if(f > 0) OVER (PARTITION BY question, i) AS df FROM tf)),
    bm AS (SELECT question, passage, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS bm FROM idf GROUP BY ALL),
    u AS (SELECT question, passage, bm * (1 + 0.5 * len(list_filter(asked, lambda m: len(list_filter(head, lambda t: {FIT})) > 0))) AS raw, {GENERAL} AS usual,
      CASE WHEN kind IN ('exact', 'begins') THEN kind WHEN kind = 'special' AND general AND len(extras) >= 2 AND len(list_filter(extras, lambda t: len(list_filter(asked, lambda m: {FIT})) > 0)) = 0 THEN 'special' ELSE '' END AS rule FROM s JOIN bm USING (question, passage)),
    v AS (SELECT question, passage, raw, raw * CASE rule WHEN 'exact' THEN 3.0::DOUBLE WHEN 'begins' THEN 1.8::DOUBLE WHEN 'special' THEN 2.0::DOUBLE / 3 ELSE 1.0::DOUBLE END * CASE WHEN usual THEN 1.4::DOUBLE ELSE 1.0::DOUBLE END AS score,
      CASE rule WHEN 'exact' THEN 0.15::DOUBLE WHEN 'special' THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN usual THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END AS adjustment FROM u)
    SELECT question, passage, score, raw, round(adjustment, 4) AS adjustment, row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, passage) AS rank FROM v WHERE score > 0 QUALIFY rank <= 5""")
def rerank_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best passages of each benchmark item by BM25 with the rules on titles and sections; its first four words ask, two more are neighbours, the first is the subject."""
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), tx.query_words(F.col("text")).alias("w"))
    asked = w.select("question", F.slice("w", 1, 4).alias("words"), F.slice("w", 5, 2).alias("neighbours"), F.get("w", F.lit(0)).alias("term"))
    return ranking.reranked(kept(candidates(spark, sf_dir), "passages"), asked, 5)


@query()
def marked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate passages' first 420 characters as HTML, with marks around the words of their question. Positions go through the normalised text, so no SQL."""
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), tx.query_words(F.col("text")).alias("w"))
    return candidates(spark, sf_dir).join(w, "question").select("question", "passage", marks.marked(F.left("text", F.lit(420)), F.col("w")).alias("html"))


@query("""SELECT s_suppkey, s_suppkey % 3 <> 0 AS same FROM supplier""")
def manifest_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two manifests say the same whatever the order of their keys: suppliers, of which every third has another size in the second."""
    s = table(spark, sf_dir, "supplier")
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    one = F.concat(F.lit('{"name": '), q("s_name"), F.lit(', "files": [{"size": '), F.col("s_suppkey").cast("string"), F.lit(', "path": '), q("s_nationkey"), F.lit("}]}"))
    size = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") + 1).otherwise(F.col("s_suppkey"))
    two = F.concat(F.lit('{ "files":[{ "path":'), q("s_nationkey"), F.lit(', "size":'), size.cast("string"), F.lit('} ],"name" : '), q("s_name"), F.lit("}"))
    return s.select("s_suppkey", (vl.canonical_json(one) == vl.canonical_json(two)).alias("same"))


@query(f"""SELECT word, letter, CAST(row_number() OVER (PARTITION BY letter ORDER BY word COLLATE fr, word) AS INT) AS place FROM
    (SELECT word, left({tx.sql_normalize("word")}, 1) AS letter FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{{L}}+')) AS word FROM benchmark))""")
def names_in_french_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of the benchmark in French order, within each first bare letter."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("\\p{L}+"), F.lit(0))).alias("word")).distinct()
    letter = F.left(tx.normalize(F.col("word")), F.lit(1))
    order = Window.partitionBy("letter").orderBy(vl.in_language(F.col("word"), "fr"), "word")
    return w.withColumn("letter", letter).withColumn("place", F.row_number().over(order))
