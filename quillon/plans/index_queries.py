"""The keyword index that stays: its state after two passes, and questions answered from its buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import postings
from quillon.operators.snapshots import Snapshot, Store
from quillon.plans.registry import query
from quillon.session import scratch, spread, table


def _pass(store: Store, docs: DataFrame, first: bool) -> Snapshot:
    """Documents as files. In the first pass French ones have only their first half yet and English ones cannot be read for now."""
    docs = docs.select(F.concat(F.lit("doc/"), "doc_id").alias("path"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    if first:
        docs = docs.withColumn("text", F.when(F.col("lang") == "fr", F.left("text", F.floor(F.length("text") / 2).cast("int"))).otherwise(F.col("text")))
    docs = docs.withColumn("late", (F.col("lang") == "en") & F.lit(first))
    listing = docs.select("path", F.octet_length("text").cast("long").alias("size"), F.when(F.col("lang") == "de", F.lit(1 - int(first))).otherwise(0).cast("long").alias("mtime"), F.sha2("text", 256).alias("hash"))
    title = F.left(F.split("text", "\n")[0], F.lit(60))
    section = lambda x: F.substring_index(x, " ", 2)

    def extract(due: DataFrame) -> DataFrame:
        lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit("[\\p{L}\\p{N}]")))
        chunks = F.transform(lines, lambda x: F.struct(section(x).alias("section"), x.alias("text")))
        late = F.col("late")
        return spread(docs).join(due.select("path"), "path").select("path", title.alias("title"), F.when(~F.coalesce(late, F.lit(False)), chunks).alias("chunks"), F.when(late, "not readable yet").alias("error"), F.when(late, "retry").alias("kind"))

    return postings.update(store, listing, extract)


def built(spark: SparkSession, sf_dir: str) -> Snapshot:
    """An index of all documents, made in two passes."""
    store, docs = Store(spark, scratch(spark, "index")), table(spark, sf_dir, "documents")
    _pass(store, docs, True)
    return _pass(store, docs, False)


LINES = """SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')) AS lines FROM documents"""


@query(f"""SELECT 'doc/' || doc_id AS path, CASE WHEN len(lines) > 0 THEN 'indexed' ELSE 'problem' END AS status, CASE WHEN len(lines) = 0 THEN 'no readable text' END AS error, len(lines) AS n_chunks,
    CASE WHEN lang = 'en' OR (lang = 'fr' AND length(text) > 0) THEN 2 ELSE 1 END AS version FROM ({LINES})""")
def index_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each file after two passes: changed files and those that waited have the second pass's version, touched ones (German) keep theirs."""
    return built(spark, sf_dir).table("files").select("path", "status", "error", "n_chunks", "version")


W = "[\\p{L}\\p{N}]+"


@query(f"""WITH c AS (SELECT 'doc/' || doc_id AS path, left(string_split(text, chr(10))[1], 60) AS title, unnest(lines) AS text, generate_subscripts(lines, 1) - 1 AS chunk FROM ({LINES})),
  cols AS (SELECT path, chunk, regexp_extract_all({tx.sql_normalize("text")}, '{W}') AS a, regexp_extract_all({tx.sql_normalize("array_to_string(string_split(text, ' ')[1:2], ' ')")}, '{W}') AS b, regexp_extract_all({tx.sql_normalize("title")}, '{W}') AS t FROM c),
  sized AS (SELECT path, chunk, len(a) + len(b) + len(t) AS n, a, b, t FROM cols),
  terms AS (SELECT path, chunk, n, term, sum(w) AS tf FROM (SELECT path, chunk, n, unnest(a) AS term, 10 AS w FROM sized UNION ALL SELECT path, chunk, n, unnest(b), 6 FROM sized UNION ALL SELECT path, chunk, n, unnest(t), 4 FROM sized) GROUP BY ALL),
  total AS (SELECT count(*) AS docs, sum(n) / greatest(count(*), 1) AS mean FROM sized),
  f AS (SELECT item_id, list_filter(regexp_extract_all({tx.sql_normalize("substr(text, 1, 200)")}, '{W}'), lambda x: length(x) >= 2) AS f FROM benchmark),
  u AS (SELECT item_id, list_filter(f, lambda x, i: list_position(f, x) = i) AS d FROM f),
  v AS (SELECT item_id, d, list_filter(d, lambda x: NOT list_contains({tx.COMMON!r}, x)) AS useful FROM u),
  q AS (SELECT item_id AS question, unnest((CASE WHEN len(useful) > 0 THEN useful ELSE d END)[1:8]) AS word FROM v),
  hit AS (SELECT question, word, path, chunk, n, sum(tf) / 10 AS f FROM q JOIN terms ON left(term, 4) = left(word, 4) WHERE term = word OR (length(word) >= 4 AND starts_with(term, word)) GROUP BY ALL),
  scored AS (SELECT question, path, chunk, sum(greatest(ln((docs - m + 0.5) / (m + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS score
    FROM hit JOIN (SELECT question, word, count(*) AS m FROM hit GROUP BY ALL) USING (question, word), total GROUP BY ALL)
  SELECT question, path, chunk, score, row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, path, chunk) AS place FROM scored QUALIFY place <= 10""")
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each benchmark item's words, from the index: text, section and title weigh 1, 0.6 and 0.4."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), tx.query_words(F.col("text")).alias("words"))
    return postings.ask(built(spark, sf_dir), asked, 10)
