"""Catalogues, registries and rollups: differences, merges, lookups, validation, pages of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import byte_size
from quillon.operators import tables as tb
from quillon.plans.registry import query
from quillon.plans.text_queries import LONG
from quillon.session import table

SQL_KNOWN = "(SELECT doc_id, least(n_chars, 2000) AS size, md5(lower(text)) AS hash FROM documents WHERE lang IS NULL OR lang <> 'de')"
SQL_PRESENT = "(SELECT doc_id, n_chars AS size, md5(text) AS hash FROM documents WHERE lang IS NULL OR lang <> 'fr')"


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a registry: the files that are there, and what is known of them from before."""
    docs = table(spark, sf_dir, "documents")
    present = docs.where("lang is null or lang <> 'fr'").select("doc_id", F.col("n_chars").alias("size"), F.md5("text").alias("hash"))
    known = docs.where("lang is null or lang <> 'de'").select("doc_id", F.least("n_chars", F.lit(2000)).alias("size"), F.md5(F.lower("text")).alias("hash"))
    return present, known


@query(f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.size IS NULL THEN 'new' WHEN a.size IS NULL THEN 'deleted' WHEN a.size = b.size THEN 'keep' WHEN a.hash = b.hash THEN 'same_hash' ELSE 'changed' END AS action FROM {SQL_PRESENT} a FULL JOIN {SQL_KNOWN} b ON a.doc_id = b.doc_id""")
def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental pass does with each file."""
    return tb.changes(*versions(spark, sf_dir), "doc_id")


@query(f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.hash IS NULL THEN 'new' WHEN b.hash IS NULL THEN 'deleted' WHEN a.hash <> b.hash THEN 'modified' ELSE 'same' END AS state FROM {SQL_KNOWN} a FULL JOIN {SQL_PRESENT} b ON a.doc_id = b.doc_id""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, modified, deleted and unchanged articles between two manifests."""
    present, known = versions(spark, sf_dir)
    return tb.diff(known, present, "doc_id", "hash")


@query(f"SELECT doc_id, size, hash FROM {SQL_PRESENT} UNION ALL SELECT doc_id, size, hash FROM {SQL_KNOWN} WHERE doc_id NOT IN (SELECT doc_id FROM {SQL_PRESENT})")
def upsert_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after its rows were put in or replaced."""
    present, known = versions(spark, sf_dir)
    return tb.upsert(known, present, "doc_id")


@query(f"SELECT (SELECT count(*) FROM {SQL_PRESENT} WHERE doc_id NOT IN (SELECT doc_id FROM {SQL_KNOWN})) AS unexpected, (SELECT count(*) FROM {SQL_KNOWN} WHERE doc_id NOT IN (SELECT doc_id FROM {SQL_PRESENT})) AS missing")
def archive_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an archive that its manifest lacks, and the other way round."""
    present, known = versions(spark, sf_dir)
    both = tb.diff(known, present, "doc_id", "hash")
    return both.agg(F.count_if(F.col("state") == "new").alias("unexpected"), F.count_if(F.col("state") == "deleted").alias("missing"))


@query("SELECT min(doc_id) AS first, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of files with the same content."""
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("h")


SQL_STORAGE = "(SELECT source AS category, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY source)"


@query(f"SELECT category, size FROM {SQL_STORAGE} UNION ALL SELECT '(other)', CAST(greatest(0, sum(strlen(text)) - sum(n_chars)) AS BIGINT) FROM documents")
def storage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size by category, and what of the used space no category explains."""
    docs = table(spark, sf_dir, "documents")
    known = docs.groupBy(F.col("source").alias("category")).agg(F.sum("n_chars").alias("size"))
    rest = docs.agg(F.greatest(F.lit(0), F.sum(F.octet_length("text")) - F.sum("n_chars")).cast("long").alias("size"))
    return known.union(rest.select(F.lit("(other)"), "size"))


@query(f"SELECT category, CAST(round(100 * size / (SELECT sum(size) FROM {SQL_STORAGE})) AS BIGINT) AS percent FROM {SQL_STORAGE}")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each category in percent."""
    known = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("category")).agg(F.sum("n_chars").alias("size"))
    total = F.sum("size").over(Window.partitionBy())  # one row a category
    return known.select("category", LONG(F.round(100 * F.col("size") / total)).alias("percent"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' o' WHEN n_chars < 10240 THEN round(n_chars / 1024, 1) || ' Ko' WHEN n_chars < 1048576 THEN CAST(round(n_chars / 1024) AS BIGINT) || ' Ko' ELSE round(n_chars / 1048576, 1) || ' Mo' END AS size FROM documents")
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes as people read them."""
    return table(spark, sf_dir, "documents").select("doc_id", byte_size("n_chars").alias("size"))


@query("SELECT c_custkey, round(CAST(CAST(c_acctbal AS DECIMAL(18, 2)) - coalesce(sum(greatest(0, CAST(o_totalprice AS DECIMAL(18, 2)) - 400000)), 0) AS DOUBLE), 2) AS free FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal")
def reserve_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free space of each device less what its running transfers still need."""
    need = F.greatest(F.lit(0).cast("decimal(18,2)"), F.col("o_totalprice").cast("decimal(18,2)") - 400000)
    used = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(need).alias("need"))
    free = F.col("c_acctbal").cast("decimal(18,2)") - F.coalesce("need", F.lit(0))
    return table(spark, sf_dir, "customer").join(used, "c_custkey", "left").select("c_custkey", F.round(free.cast("double"), 2).alias("free"))


SQL_ENTRIES = "(SELECT p_name AS name, CASE WHEN p_size > 40 THEN '-' ELSE p_brand END AS variant, min(p_partkey) AS entry FROM part WHERE p_size > 25 GROUP BY 1, 2)"


@query(f"SELECT p_partkey, min(entry) AS entry FROM part LEFT JOIN {SQL_ENTRIES} e ON e.name = p_name AND (e.variant = p_brand OR e.variant = '-') GROUP BY p_partkey")
def catalogue_variant_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pack with the first catalogue entry of its name and variant; an entry without a variant fits all."""
    part = table(spark, sf_dir, "part")
    entries = part.where("p_size > 25").select(F.col("p_name").alias("name"), F.when(F.col("p_size") > 40, "-").otherwise(F.col("p_brand")).alias("variant"), F.col("p_partkey").alias("entry"))
    packs = part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("variant"))
    return tb.variants(packs, entries).select("p_partkey", "entry")


@query("SELECT p_type, p_brand, CASE WHEN have IS NULL THEN 'absent' WHEN have = latest THEN 'installed' ELSE 'update' END AS state FROM (SELECT p_type, p_brand, max(p_size) AS latest, max(CASE WHEN p_retailprice < 1000 THEN p_size END) AS have FROM part GROUP BY p_type, p_brand)")
def prefix_join_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed files against packs, by the name that comes before the version: absent, installed or to be updated."""
    part = table(spark, sf_dir, "part").withColumn("file", F.concat_ws("_", "p_type", "p_brand", F.lpad(F.col("p_size").cast("string"), 3, "0")))
    files = part.where("p_retailprice < 1000").select(F.regexp_extract("file", "^(.*)_(\\d+)$", 1).alias("pack"), F.regexp_extract("file", "^(.*)_(\\d+)$", 2).cast("int").alias("v"))
    have = files.groupBy("pack").agg(F.max("v").alias("have"))
    packs = part.groupBy("p_type", "p_brand").agg(F.max("p_size").alias("latest")).withColumn("pack", F.concat_ws("_", "p_type", "p_brand"))
    state = F.when(F.col("have").isNull(), "absent").when(F.col("have") == F.col("latest"), "installed").otherwise("update")
    return packs.join(have, "pack", "left").select("p_type", "p_brand", state.alias("state"))


@query("SELECT c_custkey, coalesce(n_name, '00') AS country FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def zone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country of each zone, 00 where none is known."""
    known = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(known, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("00")).alias("country"))


@query("SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal <= 0, s_suppkey)) AS s_suppkey FROM supplier GROUP BY s_nationkey")
def card_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first free card, else the first one in use."""
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.struct(F.col("s_acctbal") <= 0, "s_suppkey")).alias("s_suppkey"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_name LIKE 'Supplier#00000000%')")
def same_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers with the label of the ones whose name begins as given."""
    s = table(spark, sf_dir, "supplier")
    return s.join(s.where(F.col("s_name").startswith("Supplier#00000000")).select("s_nationkey"), "s_nationkey", "left_semi").select("s_suppkey")


@query("SELECT r_name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of each category, also of empty ones."""
    return table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("n"))


@query("SELECT l_orderkey, count(*) AS n, count_if(l_linestatus = 'F') AS there, CASE WHEN count_if(l_linestatus = 'F') = 0 THEN 'absent' WHEN count_if(l_linestatus = 'F') = count(*) THEN 'complete' ELSE 'partial' END AS state FROM lineitem GROUP BY l_orderkey")
def complete_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets all of whose files are there, and partial ones, which are cleaned up."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("there"))
    return own.withColumn("state", F.when(F.col("there") == 0, "absent").when(F.col("there") == F.col("n"), "complete").otherwise("partial"))


@query("""SELECT l_suppkey, min(s) AS "start", max(e) AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY s, e, new DESC ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
    FROM (SELECT l_suppkey, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) // 10 AS e FROM lineitem))) GROUP BY l_suppkey, island""")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping stretches put together."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    own = table(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("start"), F.expr("cast(l_quantity as int) div 10").alias("d"))
    return tb.merged(own.withColumn("end", F.col("start") + F.col("d")), "l_suppkey")


SQL_URL = r"(SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS scheme, regexp_extract(url, '^\w+://([^/?#]+)', 1) AS host, regexp_extract(url, '^\w+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages)"


@query(f"SELECT page_id, scheme, host, path, q, fragment FROM {SQL_URL}")
def url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each address."""
    part = lambda rule, name: F.regexp_extract("url", rule, 1).alias(name)
    return table(spark, sf_dir, "pages").select("page_id", part(r"^(\w+)://", "scheme"), part(r"^\w+://([^/?#]+)", "host"), part(r"^\w+://[^/?#]+([^?#]*)", "path"), part(r"\?([^#]*)", "q"), part("#(.*)$", "fragment"))


@query("SELECT regexp_replace(url, '#.*$', '') AS link, min(page_id) AS first, count(*) AS n FROM pages GROUP BY 1")
def dedupe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result for each address without its fragment, the first."""
    return table(spark, sf_dir, "pages").groupBy(F.regexp_replace("url", "#.*$", "").alias("link")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))


@query("SELECT page_id, url, (SELECT count(*) FROM pages) AS total FROM pages ORDER BY url, page_id LIMIT 20 OFFSET 20")
def paginate_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 20 results, and how many there are in all."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.orderBy("url", "page_id").offset(20).limit(20).crossJoin(F.broadcast(pages.agg(F.count("*").alias("total"))))


@query(r"SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' WHEN length(html) < 200 THEN 'short' WHEN count(*) OVER (PARTITION BY url) > 1 THEN 'duplicate' WHEN NOT regexp_matches(url, '/[a-z]{2}(/|$)') THEN 'language' END AS reason FROM pages")
def validate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that an entry breaks; null for a valid one."""
    times = F.count("*").over(Window.partitionBy("url"))
    reason = F.when(~F.col("url").rlike("^https?://"), "scheme").when(F.length("html") < 200, "short").when(times > 1, "duplicate").when(~F.col("url").rlike("/[a-z]{2}(/|$)"), "language")
    return table(spark, sf_dir, "pages").select("page_id", reason.alias("reason"))


@query(r"SELECT page_id, least(5, greatest(1, coalesce(TRY_CAST(regexp_extract(url, '[?&]page=([^&#]*)', 1) AS INT), 1))) AS page FROM pages")
def page_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that is shown: the first if none is asked for, the last if there are fewer."""
    asked = F.regexp_extract("url", "[?&]page=([^&#]*)", 1).try_cast("int")
    return table(spark, sf_dir, "pages").select("page_id", F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(asked, F.lit(1)))).alias("page"))


@query(f"""SELECT page_id, CASE WHEN host LIKE 'm.%' THEN 204 WHEN host LIKE '%.net' AND path LIKE '/en/%' THEN 200 WHEN host LIKE '%.com' THEN 302 ELSE 404 END AS answer FROM {SQL_URL}""")
def first_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of the first rule of a table that fits an address: exact or by wildcard; 404 if none does."""
    rules = spark.createDataFrame([(0, "m.*", "*", 204), (1, "*.net", "/en/*", 200), (2, "*.com", "*", 302)], "ordinal int, host string, path string, answer int")
    own = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^\w+://([^/?#]+)", 1).alias("_host"), F.regexp_extract("url", r"^\w+://[^/?#]+([^?#]*)", 1).alias("_path"))
    return tb.first_rule(own, rules, ["host", "path"]).select("page_id", F.coalesce("answer", F.lit(404)).alias("answer"))
