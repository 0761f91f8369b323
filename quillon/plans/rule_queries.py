"""Rules on messages, titles and expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import rules
from quillon.functions import text as tx
from quillon.operators import retrieval as rt
from quillon.plans.registry import query
from quillon.plans.text_queries import LONG, NORM, SQL_QUERY_WORDS, STOP, WORDS
from quillon.session import table

_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_any = lambda xs: f"list_has_any(w, {_list(xs)})"
SQL_TALK = " ".join(f"WHEN {_any(keys)} THEN '{name}'" for name, keys in [*rules.DECIDING.items(), ("salutation", rules.GREETING)])
SQL_SMALL = _list(sorted({x for group in rules.SMALL_TALK.values() for x in group}))
SQL_DANGER = " OR ".join("(" + " AND ".join(f"(list_has_any(w, {_list(rules.forms(g))}) OR list_has_any(r, {_list(rules.forms(g))}))" for g in rule) + ")" for rule in rules.DANGER)
SQL_USEFUL = f"list_filter({WORDS}, lambda x: length(x) >= 3 AND x NOT IN ({STOP}))"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'")


@query(rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(trim(regexp_replace(regexp_replace({NORM}, '[''-]', ' ', 'g'), ' +', ' ', 'g')), '{"|".join(f"(?:{x})" for x in rules.SELF)}') THEN 'soi'
    WHEN len(w) BETWEEN 1 AND 6 AND len(list_filter(w, lambda x: NOT list_contains({SQL_SMALL}, x))) = 0 THEN CASE {SQL_TALK} END END AS category
    FROM (SELECT *, {WORDS} AS w FROM conversations WHERE role = 'user')""")
def small_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are small talk, not questions to search for, by category."""
    return turns(spark, sf_dir).select("conv_id", "turn", rules.small_talk(F.col("text")).alias("category"))


@query(f"SELECT conv_id, turn, {SQL_DANGER} AS danger FROM (SELECT conv_id, turn, w, list_transform(w, lambda x: regexp_replace(x, '{rules.ENDING}', '')) AS r FROM (SELECT conv_id, turn, {WORDS} AS w FROM conversations WHERE role = 'user'))")
def danger_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a word of every group of some rule."""
    w = turns(spark, sf_dir).select("conv_id", "turn", F.array_distinct(tx.tokens(tx.normalize(F.col("text")))).alias("w"))
    return w.select("conv_id", "turn", rules.in_danger(F.col("w")).alias("danger"))


@query("""SELECT doc_id, CASE WHEN t = 'la' THEN 'exact' WHEN starts_with(t, 'la ') AND len(list_filter(string_split(t, ' '), lambda x: x NOT IN ('', 'la'))) <= 1 THEN 'commence' WHEN contains(t, 'la') THEN 'specialise' ELSE 'aucun' END AS relation
    FROM (SELECT doc_id, trim(regexp_replace(""" + tx.sql_normalize("string_split(coalesce(text, ''), '.')[1]") + """, ' +', ' ', 'g')) AS t FROM documents)""")
def title_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the first sentence of each document relates to a term."""
    title = F.get(F.split(F.coalesce("text", F.lit("")), "\\."), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", rules.title_relation(title, "la").alias("relation"))


SQL_SAME = "(a = b OR (length(a) >= 4 AND starts_with(b, a)) OR (length(b) >= 4 AND starts_with(a, b)) OR (length(a) >= 5 AND length(b) >= 5 AND a[1:4] = b[1:4]))"


@query(f"""WITH u AS (SELECT conv_id, turn, {SQL_USEFUL} AS w FROM conversations WHERE role = 'user'), p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM u),
    hit AS (SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn, a, unnest(v) AS b FROM (SELECT conv_id, turn, v, unnest(w) AS a FROM p)) WHERE {SQL_SAME})
    SELECT p.conv_id, p.turn, coalesce(len(v), 0) = 0 OR hit.turn IS NOT NULL AS on_topic FROM p LEFT JOIN hit USING (conv_id, turn)""")
def follow_up_on_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a question shares a word with the one before it in its conversation; one without useful words asks for nothing."""
    useful = F.filter(tx.tokens(tx.normalize(F.col("text"))), lambda x: (F.length(x) >= 3) & ~x.isin(tx.COMMON))
    w = turns(spark, sf_dir).select("conv_id", "turn", F.array_distinct(useful).alias("w"))
    w = w.withColumn("v", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")))
    shared = F.exists("w", lambda a: F.exists("v", lambda b: rules.same_word(a, b)))
    return w.select("conv_id", "turn", (F.coalesce(F.size("v") <= 0, F.lit(True)) | F.coalesce(shared, F.lit(False))).alias("on_topic"))


@query(f"""SELECT doc_id, CAST(count(i) + coalesce(sum(x), 0) AS BIGINT) AS n, CAST(coalesce(sum(i * (1 + x)), 0) AS BIGINT) AS total FROM documents LEFT JOIN
    (SELECT doc_id, i, CAST(c IN ({", ".join(f"'{x}'" for x in tx.LIGATURES)}) AS INT) AS x FROM (SELECT doc_id, unnest(range(length(text))) AS i, unnest(string_split(text, '')) AS c FROM documents)) USING (doc_id) GROUP BY doc_id""")
def normal_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and sum of the map from each normalised text's characters to the original's."""
    at = table(spark, sf_dir, "documents").select("doc_id", rules.positions(F.coalesce("text", F.lit(""))).alias("at"))
    return at.select("doc_id", LONG(F.size("at")).alias("n"), F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""WITH e AS (SELECT item_id, words[1] AS a, words[2] AS b FROM {SQL_QUERY_WORDS} WHERE len(words) >= 2), c AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations WHERE role = 'user'),
    m AS (SELECT conv_id, turn, item_id, unnest([a, b]) AS word FROM c JOIN e ON list_contains(w, a) AND list_contains(w, b))
    SELECT DISTINCT conv_id, turn, min(item_id) OVER (PARTITION BY conv_id, turn, word) AS item_id FROM m""")
def expression_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy cover: of the expressions found in a question, in order, those that bring a word no earlier one has."""
    w = table(spark, sf_dir, "benchmark").select("item_id", tx.query_words(F.col("text")).alias("w")).where("size(w) >= 2").select("item_id", F.slice("w", 1, 2).alias("expression"))
    asked = turns(spark, sf_dir).select("conv_id", "turn", tx.tokens(tx.normalize(F.col("text"))).alias("words"))
    found = rt.contained(asked, "words", w, "expression").select("conv_id", "turn", "item_id", F.explode("expression").alias("word"))
    return rt.greedy_cover(found, ["conv_id", "turn"], "item_id", "word")
