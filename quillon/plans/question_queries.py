"""What is searched for a question, whether it is grave, and which terms and pages count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import lexicon as lx
from quillon.functions import rules
from quillon.functions import text as tx
from quillon.operators import questions
from quillon.plans.content_queries import asked, sql_list, sql_words
from quillon.plans.registry import query
from quillon.plans.rule_queries import SQL_DANGER, SQL_SAME, turns
from quillon.session import spread, table

STEM = f"regexp_replace(x, '{rules.ENDING}', '')"
FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
USEFUL = f"(length(x) >= 3 AND NOT list_contains({sql_list(lx.EMPTY)}, x))"
PADDED = "' ' || array_to_string({0}, ' ') || ' '"


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as a table of expressions: words 1, 1-2 and 3-4 of each item say it, 5 and 6-7 are searched, 8 goes along."""
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry"), tx.tokens(tx.normalize(F.col("text"))).alias("w")).where("size(w) >= 8")
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    return w.select("entry", F.array(part(1, 1), part(1, 2), part(3, 2)).alias("said"), F.array(part(5, 1), part(6, 2)).alias("search"), F.array(part(8, 1)).alias("also"), part(1, 1).alias("theme"))


SQL_KNOWN = f"""WITH b AS (SELECT item_id AS entry, {sql_words("text")} AS w FROM benchmark), said AS (SELECT entry, unnest([w[1:1], w[1:2], w[3:4]]) AS s, unnest([0, 1, 2]) AS nth FROM b WHERE len(w) >= 8),
    pat AS (SELECT entry, nth, stems, CASE WHEN len(s) > 1 AND len(stems) = 1 THEN {PADDED.format("s")} END AS exact, len(stems) AS n, length(array_to_string(stems, ' ')) AS size FROM
      (SELECT *, list_distinct(list_transform(list_filter(s, lambda x: NOT list_contains({sql_list(questions.SMALL)}, x)), lambda x: {STEM})) AS stems FROM said) WHERE len(stems) > 0),
    turn AS (SELECT conv_id * 1000 + turn AS question, text, {sql_words("text")} AS w FROM conversations WHERE role = 'user'),
    hit AS (SELECT question, entry, nth, p.stems, n, size FROM (SELECT *, list_distinct(list_transform(w, lambda x: {STEM})) AS stems FROM turn) t JOIN pat p ON list_has_all(t.stems, p.stems) AND (exact IS NULL OR contains({PADDED.format("w")}, exact))),
    own AS (SELECT * FROM (SELECT question, entry, nth, n, size, unnest(stems) AS word FROM hit) QUALIFY row_number() OVER (PARTITION BY question, word ORDER BY n DESC, size DESC, entry, nth) = 1),
    best AS (SELECT DISTINCT question, entry, first_value(n) OVER o AS n, first_value(size) OVER o AS size FROM own WINDOW o AS (PARTITION BY question, entry ORDER BY n DESC, size DESC, nth)),
    lists AS (SELECT question, flatten(list([w[5], array_to_string(w[6:7], ' ')] ORDER BY n DESC, size DESC, entry)) AS s, list(w[8] ORDER BY n DESC, size DESC, entry) AS a, list(w[1] ORDER BY n DESC, size DESC, entry) AS t FROM best JOIN b USING (entry) GROUP BY question),
    known AS (SELECT question, text, w, search, list_filter({FIRST.format("a")}, lambda x: NOT list_contains(search, x)) AS also, {FIRST.format("t")} AS themes FROM
      (SELECT question, text, w, {FIRST.format("s")} AS search, a, t FROM (SELECT question, text, w, coalesce(s, []) AS s, coalesce(a, []) AS a, coalesce(t, []) AS t FROM turn LEFT JOIN lists USING (question))))"""


@query(f"""{SQL_KNOWN}, c AS (SELECT *, list_filter(w, lambda x: {USEFUL} AND NOT list_contains(list_filter(regexp_extract_all(array_to_string(search, ' '), '[\\p{{L}}\\p{{N}}]+'), lambda x: {USEFUL}), x)) AS useful,
      regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+') AS raw FROM known),
    s AS (SELECT *, list_filter({FIRST.format("raw")}, lambda x: length(x) >= 4 AND list_contains(useful, {tx.sql_normalize("x")})) AS single FROM c)
    SELECT question, search[1] AS term, array_to_string(search, '|') AS search, array_to_string(also, '|') AS also, array_to_string(themes, '|') AS themes,
      array_to_string(list_concat([text], search[1:3], list_transform(list_sort(list_transform(single, lambda x, i: {{'n': -length(x), 'i': i, 'w': x}})), lambda x: x.w))[1:6], '|') AS searches,
      CASE WHEN len(search) > 0 THEN text || ' (' || array_to_string(search, ', ') || ')' ELSE text END AS vector_text FROM s""")
def question_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's question with the terms of the table of expressions, its searches and the text for its vector."""
    known = questions.understood(asked(spark, sf_dir), "question", "text", questions.patterns(dictionary(spark, sf_dir)))
    told = lambda c: F.array_join(c, "|").alias(c)
    return questions.prepared(known, "text").select("question", "term", told("search"), told("also"), told("themes"), told("searches"), "vector_text")


SQL_SIGNS = " OR ".join(f"regexp_matches(t, '{x}')" for x in rules.SIGNS)


@query(f"""SELECT conv_id, turn, coalesce({SQL_SIGNS} OR {SQL_DANGER} OR (turn % 4 = 0 AND NOT regexp_matches(t, '{rules.COMMON_INJURY}')), FALSE) AS serious FROM
    (SELECT *, list_transform(w, lambda x: {STEM}) AS r FROM (SELECT conv_id, turn, t, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+') AS w FROM
    (SELECT conv_id, turn, regexp_replace(replace({tx.sql_normalize("text")}, '''', ' '), ' +', ' ', 'g') AS t FROM conversations WHERE role = 'user')))""")
def serious_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that show a grave danger; the model's flag is set on every second question of a conversation."""
    return turns(spark, sf_dir).select("conv_id", "turn", rules.serious(F.col("text"), F.col("turn") % 4 == 0).alias("serious"))


SQL_TERM = rules.TERM.replace("'", "''")


@query(rf"""WITH u AS (SELECT conv_id, turn, text, list_filter({sql_words("text")}, lambda x: {USEFUL}) AS asked, trim(coalesce(regexp_extract(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '^[^ ]+ [^ ]+'), '')) AS p FROM conversations WHERE role = 'user'),
    v AS (SELECT *, list_filter({sql_words("p")}, lambda x: {USEFUL}) AS w FROM u), e AS (SELECT DISTINCT conv_id, turn, a, unnest(asked) AS b FROM (SELECT conv_id, turn, asked, unnest(w) AS a FROM v)),
    n AS (SELECT conv_id, turn, count(DISTINCT a) AS n FROM e WHERE {SQL_SAME} GROUP BY ALL)
    SELECT conv_id, turn, CASE WHEN len(w) > 0 AND coalesce(n, 0) = len(list_distinct(w)) AND regexp_matches(p, '{SQL_TERM}') THEN p END AS term FROM v LEFT JOIN n USING (conv_id, turn)""")
def term_of_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of the question before, as a term, where the question itself bears them out."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns(spark, sf_dir).select("conv_id", "turn", "text", F.trim(F.coalesce(F.regexp_extract(before, "^[^ ]+ [^ ]+", 0), F.lit(""))).alias("p"))
    return rows.select("conv_id", "turn", rules.term_of_question(F.col("p"), lx.useful_words(F.col("p")), lx.useful_words(F.col("text"))).alias("term"))


@query(f"""SELECT doc_id, coalesce(len(regexp_extract_all(text, '{rules.DEFINITION.replace("'", "''")}\\b')) >= {rules.DEFINITIONS}, FALSE) AS glossary FROM documents""")
def glossary_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is a page of word definitions, which would answer any question."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", rules.glossary(F.col("text")).alias("glossary"))
