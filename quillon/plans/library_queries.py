"""Catalogue joins, table maintenance and presentation order. The given tables stand in for catalogues, installs and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import retrieval as rt
from quillon.operators import tables as tb
from quillon.plans.catalogue_queries import SQL_URL
from quillon.plans.registry import query
from quillon.session import table


@query("""SELECT coalesce(s.s_suppkey, i.l_partkey) AS id, s.s_name AS name, i.n AS files, CASE WHEN s.s_suppkey IS NULL THEN 'off catalogue' WHEN i.n IS NULL THEN 'available' ELSE 'installed' END AS state
    FROM supplier s FULL JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) i ON s.s_suppkey = i.l_partkey""")
def catalogue_with_installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue (suppliers) with what is installed (line items by part); installed items that it lacks are appended with a flag."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    there = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("files"))
    state = F.when(F.col("name").isNull(), "off catalogue").when(F.col("files").isNull(), "available").otherwise("installed")
    return known.join(there, "id", "full_outer").select("id", "name", "files", state.alias("state"))


@query("""SELECT p_partkey, CASE WHEN e.digest IS NULL THEN 'absent' WHEN starts_with(e.digest, left(md5(p_name), 12)) THEN 'current' ELSE 'outdated' END AS state
    FROM part LEFT JOIN (SELECT p_partkey AS tag, md5(CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name END) AS digest FROM part WHERE p_size % 5 <> 0) e ON tag = p_partkey""")
def models_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of the catalogue against those of an engine, by tag; the catalogue knows the beginning of a digest. Stand-in: parts, of which
    the engine lacks every fifth size and has every third in another version."""
    part = table(spark, sf_dir, "part")
    own = part.where("p_size % 5 <> 0").select("p_partkey", F.md5(F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))).alias("digest"))
    state = F.when(F.col("digest").isNull(), "absent").when(F.startswith("digest", F.left(F.md5("p_name"), F.lit(12))), "current").otherwise("outdated")
    return part.join(own, "p_partkey", "left").select("p_partkey", state.alias("state"))


@query("SELECT s_suppkey, n_name AS title, r_name AS pack FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def installed_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed files with their title and, by it, their pack; null where either is unknown."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    found = table(spark, sf_dir, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return found.select("s_suppkey", F.col("n_name").alias("title"), F.col("r_name").alias("pack"))


@query("""SELECT event_type, coalesce(name, CAST(user_id AS VARCHAR)) AS source, count(*) AS n FROM events LEFT JOIN (SELECT n_name AS name, unnest([n_nationkey, n_nationkey + 50]) AS address FROM nation) ON address = user_id GROUP BY 1, 2""")
def blocked_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows by type and source; an address is shown by the name that owns it, of which one may have several."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.explode(F.array(F.col("n_nationkey"), F.col("n_nationkey") + 50)).alias("user_id"))
    found = table(spark, sf_dir, "events").select("event_type", "user_id").join(names, "user_id", "left")
    return found.groupBy("event_type", F.coalesce("name", F.col("user_id").cast("string")).alias("source")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 OR p_type LIKE 'STANDARD%' THEN NULL WHEN p_type LIKE 'PROMO%' THEN 'files/' || p_brand WHEN p_type LIKE 'ECONOMY%' THEN 'packs/' || p_partkey ELSE 'other' END AS rule FROM part""")
def removal_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each content may be removed, by its kind; null where it is protected or part of the base. Kinds are those of parts."""
    kind = lambda x: F.col("p_type").startswith(x)
    rule = F.when((F.col("p_size") < 10) | kind("STANDARD"), F.lit(None)).when(kind("PROMO"), F.concat(F.lit("files/"), "p_brand")).when(kind("ECONOMY"), F.concat(F.lit("packs/"), "p_partkey")).otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", rule.alias("rule"))


@query("SELECT l_returnflag AS pack, count(*) AS files, sum(l_linenumber) AS size, CAST(row_number() OVER (ORDER BY l_returnflag <> 'R', l_returnflag) AS INT) AS position FROM lineitem GROUP BY l_returnflag")
def pack_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each pack over its files, the base pack first, then by name; ordered after the sums, one row a pack."""
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("pack")).agg(F.count("*").alias("files"), F.sum("l_linenumber").alias("size"))
    return tb.positions(found, F.col("pack") != "R", "pack")


@query("SELECT pack, sum(size) AS size FROM (SELECT l_suppkey, min(l_returnflag) AS pack, max(l_linenumber) AS size FROM lineitem GROUP BY l_suppkey) GROUP BY pack")
def shared_files_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each pack where a file that several packs share counts for the first of them only."""
    files = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_returnflag").alias("pack"), F.max("l_linenumber").cast("long").alias("size"))
    return files.groupBy("pack").agg(F.sum("size").alias("size"))


@query("SELECT l_returnflag AS project, count(*) AS total, count_if(l_linestatus = 'F') AS healthy FROM lineitem GROUP BY 1")
def healthy_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each project's containers are healthy."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("project")).agg(F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("healthy"))


@query("""SELECT n_nationkey, max(s_acctbal) AS memory, CASE WHEN max(s_acctbal) IS NULL THEN 'none' WHEN max(s_acctbal) < 7680 THEN 'small' ELSE 'fits' END AS reason
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""")
def largest_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest card's memory on each machine, and whether it reaches 7680."""
    found = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.max("s_acctbal").alias("memory"))
    return found.withColumn("reason", F.when(F.col("memory").isNull(), "none").when(F.col("memory") < 7680, "small").otherwise("fits"))


@query("SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice DESC, p_partkey) AS INT) AS rank FROM part")
def layer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of each map: the least zoom first, of equal ones the largest area (here: price)."""
    return rt.cap(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice"), "p_brand", 1 << 30, "p_size", F.desc("p_retailprice"), "p_partkey").select("p_brand", "p_partkey", "rank")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS updated FROM orders ORDER BY updated DESC, o_orderkey LIMIT 50")
def latest_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 articles updated last, then by title (here: key); a top-k, no full sort."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("updated")).orderBy(F.desc("updated"), "o_orderkey").limit(50)


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:3], chr(10)) AS head FROM documents")
def first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three blocks of each document, in order."""
    blocks = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(blocks, 1, 3), "\n").alias("head"))


@query("SELECT s_nationkey, s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal <= 0, s_suppkey) AS INT) AS rank FROM supplier")
def available_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that are available first, else in the catalogue's order."""
    return rt.cap(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), "s_nationkey", 1 << 30, F.col("s_acctbal") <= 0, "s_suppkey").select("s_nationkey", "s_suppkey", "rank")


@query("""SELECT l_suppkey, l_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY best DESC, l_orderkey) AS rank
    FROM (SELECT l_suppkey, l_orderkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1, 2)) WHERE rank <= 3""")
def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three distinct documents (orders) of each ranked list of passages (line items of a supplier, by price)."""
    best = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.max("l_extendedprice").alias("best"))
    return rt.cap(best, "l_suppkey", 3, F.desc("best"), "l_orderkey").select("l_suppkey", "l_orderkey", "rank")


@query("SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY len(string_split(p_name, ' ')) DESC, length(p_name) DESC, p_partkey) AS INT) AS rank FROM part")
def expression_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions of a theme, the most precise first: by words, then by length, then as given."""
    own = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.size(F.split("p_name", " ")).alias("words"), F.length("p_name").alias("length"))
    return rt.cap(own, "p_brand", 1 << 30, F.desc("words"), F.desc("length"), "p_partkey").select("p_brand", "p_partkey", "rank")


@query("""SELECT c.conv_id, c.turn, len(list_filter(string_split(lower(c.text), ' '), lambda x: list_contains(string_split(lower(f.text), ' '), x))) AS shared
    FROM conversations c JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 0 WHERE c.turn > 0""")
def shared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of a message the conversation's first one has; repeats count."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("w"))
    first = rows.where("turn = 0").select("conv_id", F.col("w").alias("f"))
    return rows.where("turn > 0").join(first, "conv_id").select("conv_id", "turn", F.size(F.filter("w", lambda x: F.array_contains("f", x))).cast("long").alias("shared"))


SQL_IMAGE = "'registry:5000/' || replace(p_name, ' ', '-') || CASE WHEN p_size % 2 = 0 THEN ':' || p_size ELSE '' END"


@query(rf"SELECT p_partkey, regexp_extract(image, '^(.*?)(:[^:/]+)?$', 1) AS name, coalesce(nullif(regexp_extract(image, ':([^:/]+)$', 1), ''), 'latest') AS tag FROM (SELECT p_partkey, {SQL_IMAGE} AS image FROM part)")
def image_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and tag of an image; a colon before a slash is a port, no tag means latest."""
    image = F.concat(F.lit("registry:5000/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(":"), "p_size")).otherwise(""))
    own = table(spark, sf_dir, "part").select("p_partkey", image.alias("image"))
    tag = F.regexp_extract("image", ":([^:/]+)$", 1)
    return own.select("p_partkey", F.regexp_extract("image", "^(.*?)(:[^:/]+)?$", 1).alias("name"), F.when(tag != "", tag).otherwise("latest").alias("tag"))


@query("SELECT item_id, CAST(('0x' || left(md5(text), 8)) AS BIGINT) % 5 AS sentence FROM benchmark")
def stable_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of five sentences answers a question that has no answer: by the question's hash, so always the same."""
    return table(spark, sf_dir, "benchmark").select("item_id", (F.conv(F.left(F.md5("text"), F.lit(8)), 16, 10).cast("long") % 5).alias("sentence"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'
    UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_linenumber <= 3""")
def replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks after a pass: those of changed files (open orders) replaced whole by their new ones, those of deleted files (orders in part) gone."""
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), table(spark, sf_dir, "orders")
    keys = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    own = lambda df: tb.dealt(df, "l_orderkey", 8 * lines.rdd.getNumPartitions())
    new = own(lines.where("l_linenumber <= 3")).join(own(keys.where("o_orderstatus = 'O'").drop("o_orderstatus")), "l_orderkey").withColumn("l_quantity", F.col("l_quantity") + 1)
    return tb.replace_children(lines, new, keys.where("o_orderstatus <> 'F'"), "l_orderkey")


@query("""SELECT s_suppkey, coalesce(o.n, k.n) AS size, o.n IS NULL AND k.n IS NOT NULL AS remembered FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_shipdate >= DATE '1998-11-01' GROUP BY 1) o ON o.l_suppkey = s_suppkey
    LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_shipdate < DATE '1998-11-01' GROUP BY 1) k ON k.l_suppkey = s_suppkey""")
def known_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each item as the catalogue tells it now, else the last one known."""
    late = F.col("l_shipdate") >= F.lit("1998-11-01").cast("date")
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_if(late).alias("now"), F.count_if(~late).alias("last"))
    found = table(spark, sf_dir, "supplier").select("s_suppkey").join(sizes, "s_suppkey", "left")
    now, last = F.nullif("now", F.lit(0)), F.nullif("last", F.lit(0))
    return found.select("s_suppkey", F.coalesce(now, last).alias("size"), (now.isNull() & last.isNotNull()).alias("remembered"))


@query(f"SELECT host, split_part(path, '/', 2) AS folder, count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS size FROM {SQL_URL} JOIN pages USING (page_id) GROUP BY 1, 2")
def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and size under each first folder of a host."""
    part = lambda rule: F.regexp_extract("url", rule, 1)
    folder = F.split_part(part(r"^\w+://[^/?#]+([^?#]*)"), F.lit("/"), F.lit(2))
    return table(spark, sf_dir, "pages").groupBy(part(r"^\w+://([^/?#]+)").alias("host"), folder.alias("folder")).agg(F.count("*").alias("files"), F.sum(F.length("html")).alias("size"))


@query("SELECT conv_id, turn, CASE WHEN starts_with(b, 'the ') THEN 'yes' WHEN starts_with('the ', b) THEN 'maybe' ELSE 'no' END AS state FROM (SELECT conv_id, turn, left(lower(text), CAST(turn AS INT) % 6) AS b FROM conversations)")
def marker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what has come of a message so far (here: as many characters as its turn allows) begins with a marker, may yet, or cannot."""
    so_far = F.left(F.lower("text"), (F.col("turn") % 6).cast("int"))
    state = F.when(F.startswith(so_far, F.lit("the ")), "yes").when(F.startswith(F.lit("the "), so_far), "maybe").otherwise("no")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", state.alias("state"))
