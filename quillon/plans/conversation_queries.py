"""Conversations kept in a store, and what is wrong with entries of catalogues and with manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import checks
from quillon.operators import conversations as cv
from quillon.operators import manifests
from quillon.operators.snapshots import Store
from quillon.plans.registry import query
from quillon.session import scratch, table


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns with the answer that follows; times from their numbers."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("_next", F.lead("role").over(by)).withColumn("answer", F.lead("text").over(by))
    rows = rows.where("role = 'user' and _next = 'assistant' and answer is not null").withColumn("nth", F.row_number().over(by))
    at = F.col("conv_id") * 1000 + F.col("turn")
    return rows.select("conv_id", "nth", at.alias("request"), F.col("text").alias("question"), "answer", F.array(F.lit("book")).alias("sources"), F.lit(1).alias("outcome"), F.timestamp_seconds(at).alias("asked"), F.timestamp_seconds(at + 1).alias("answered"))


@query(r"""WITH t AS (SELECT *, lead(role) OVER w AS following, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    e AS (SELECT conv_id, turn, text AS question, answer FROM t WHERE role = 'user' AND following = 'assistant' AND answer IS NOT NULL),
    c AS (SELECT conv_id, arg_min(question, turn) AS question, min(conv_id * 1000 + turn) AS created, max(conv_id * 1000 + turn) AS changed, 2 * count(*) AS n_messages, arg_max(answer, turn) AS last_text FROM e GROUP BY conv_id),
    i AS (SELECT *, row_number() OVER (ORDER BY created) AS id FROM c)
    SELECT id, CASE WHEN id % 3 = 0 AND id % 6 <> 0 THEN 'Titre ' || id ELSE coalesce(nullif(left(trim(regexp_replace(coalesce(question, ''), '\s+', ' ', 'g')), 50), ''), 'Sans titre') END AS title, created, changed, n_messages, md5(last_text) AS last_md5 FROM i WHERE id % 5 <> 0""")
def conversation_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations through the store: the first exchange of each makes it, the others follow, every third gets a title (half of them an empty one), every fifth goes."""
    store, rows = Store(spark, scratch(spark, "conversations")), exchanges(spark, sf_dir)
    none = F.lit(None).cast("long")
    first = rows.where("nth = 1")
    made = cv.add(store, first.withColumn("conversation", none))
    ids = first.select("conv_id", "request").join(made, "request").select("conv_id", "conversation")
    cv.add(store, rows.where("nth > 1").join(ids, "conv_id"))
    known = cv.present(store.snapshot()).select("id")
    cv.rename(store, known.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 != 0, F.concat(F.lit("  Titre \n "), F.col("id").cast("string"))).otherwise(F.lit(" ")).alias("title")))
    cv.delete(store, known.where("id % 5 = 0"))
    state = store.snapshot()
    told = cv.messages(state).groupBy(F.col("conversation").alias("id")).agg(F.count("*").alias("n_messages"), F.md5(F.max_by("text", F.struct("at", F.col("kind") == "answer"))).alias("last_md5"))
    return cv.present(state).join(told, "id").select("id", "title", F.unix_seconds("created").alias("created"), F.unix_seconds("changed").alias("changed"), "n_messages", "last_md5")


HOST, FOLDER = "^https?://([^/?#]+)", "^https?://[^/]+/([^/?#]+)"


@query(rf"""SELECT page_id, CASE WHEN lang = 'de' THEN 'id' WHEN page_id % 13 = 0 THEN 'type' WHEN lang IN ('', 'es') THEN 'langue' WHEN page_id % 7 = 0 THEN 'auteurs' WHEN page_id % 17 = 0 THEN 'licence' WHEN NOT starts_with(url, 'https://') THEN 'sources' WHEN page_id % 11 = 0 THEN 'sha256' WHEN page_id % 19 = 0 THEN 'taille' END AS reason
    FROM (SELECT page_id, url, regexp_extract(url, '{FOLDER}', 1) AS lang FROM pages)""")
def catalogue_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an entry of a catalogue of books is of no use: the pages as entries in JSON, with faults by language, number and address."""
    lang, n = F.regexp_extract("url", FOLDER, 1), F.col("page_id")
    name = F.concat(F.lit("page-"), n.cast("string"))
    text = lambda x: F.lit(x)
    entry = F.struct(
        F.when(lang == "de", F.concat(name, F.lit("_"))).otherwise(name).alias("id"),
        F.when(n % 13 == 0, text("epub")).otherwise(text("pdf")).alias("type"),
        name.alias("titre"), text("maison").alias("editeur"), F.when(lang == "es", text("  ")).otherwise(lang).alias("langue"), text("sante").alias("categorie"), text("x").alias("attribution"),
        F.when(n % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(text("a"), text("b"))).alias("auteurs"),
        F.struct(text("libre").alias("nom"), F.when(n % 17 != 0, text("https://example.org/l")).alias("url")).alias("licence"),
        F.array("url").alias("sources"),
        F.when(n % 11 == 0, F.md5("html")).otherwise(F.sha2("html", 256)).alias("sha256"),
        F.when(n % 19 == 0, F.lit(2.5)).otherwise(F.octet_length("html").cast("double")).alias("taille"),
    )
    return table(spark, sf_dir, "pages").select("page_id", checks.book_reason(F.try_parse_json(F.to_json(entry))).alias("reason"))


@query(rf"""WITH p AS (SELECT page_id, url, html, regexp_extract(url, '{HOST}', 1) AS manifest, regexp_extract(url, '{FOLDER}', 1) AS category, regexp_extract(url, '([^/?#]+)/*(?:[?#].*)?$', 1) AS slug FROM pages),
    k AS (SELECT DISTINCT manifest, category FROM p WHERE page_id % 4 <> 0),
    a AS (SELECT p.manifest, page_id, p.slug, CASE WHEN NOT regexp_matches(slug, '{checks.SLUG}') OR length(slug) > 150 THEN 'article' WHEN page_id > min(page_id) OVER (PARTITION BY p.manifest, slug) THEN 'article again' WHEN k.category IS NULL THEN 'unknown category'
      WHEN page_id % 11 = 0 THEN 'dates' WHEN page_id % 13 = 0 THEN 'sha256' END AS reason FROM p LEFT JOIN k ON p.manifest = k.manifest AND p.category = k.category),
    c AS (SELECT manifest, min(category) AS slug FROM k WHERE NOT regexp_matches(category, '{checks.SLUG}') GROUP BY manifest),
    f AS (SELECT manifest, arg_min(reason, page_id) AS reason, arg_min(slug, page_id) AS item FROM a WHERE reason IS NOT NULL GROUP BY manifest)
    SELECT m.manifest, CASE WHEN n % 5 = 0 THEN 'format' WHEN c.slug IS NOT NULL THEN 'category' WHEN f.reason IS NOT NULL THEN f.reason WHEN NOT starts_with(url, 'https://') THEN 'archive elsewhere' END AS reason,
      CASE WHEN n % 5 = 0 THEN NULL WHEN c.slug IS NOT NULL THEN c.slug ELSE f.item END AS item FROM (SELECT manifest, count(*) AS n, arg_min(url, page_id) AS url FROM p GROUP BY manifest) m LEFT JOIN c USING (manifest) LEFT JOIN f USING (manifest)""")
def manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each host's manifest: pages are its articles, folders its categories, its first page's address that of the archive."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.regexp_extract("url", HOST, 1).alias("manifest"), F.regexp_extract("url", FOLDER, 1).alias("category"), F.regexp_extract("url", r"([^/?#]+)/*(?:[?#].*)?$", 1).alias("slug"))
    n = F.col("page_id")
    folders = pages.where("page_id % 4 <> 0").select("manifest", F.col("category").alias("slug")).distinct()
    kinds = folders.select("manifest", F.row_number().over(Window.partitionBy("manifest").orderBy("slug")).alias("pos"), "slug", F.lit("t").alias("title"), F.lit("").alias("description"), F.lit(1.0).alias("place"))
    day = F.when(n % 11 == 0, "hier").otherwise("2024-05-01")
    own = pages.select("manifest", n.alias("pos"), "slug", F.lit("t").alias("title"), F.lit("").alias("summary"), "category", F.lit("2024-05-01T10:00").alias("published"), day.alias("updated"), F.when(n % 13 == 0, F.lit("?")).otherwise(F.sha2("html", 256)).alias("sha256"))
    head = pages.groupBy("manifest").agg(F.count("*").alias("n"), F.min_by("url", "page_id").alias("url"))
    head = head.select("manifest", F.when(F.col("n") % 5 == 0, 2).otherwise(1).alias("format"), F.lit("1").alias("version"), F.lit("2024-05-01").alias("generated_at"), F.lower(F.concat(F.lit("https://"), "manifest")).alias("origin"), F.sha2("url", 256).alias("sha256"), F.col("n").alias("size"), "url")
    return manifests.faults(head, kinds, own)
