"""Text analysis: normalising, words, blocks, sections, chunks, excerpts, answer checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import text_units as tu
from quillon.plans.registry import query
from quillon.session import table

NORM = tx.sql_normalize("text")
WORDS = f"regexp_extract_all({NORM}, '[\\p{{L}}\\p{{N}}]+')"
LONG = lambda c: F.col(c).cast("long") if isinstance(c, str) else c.cast("long")
SQL_BLOCKS = """(SELECT doc_id, i AS pos, lines[i + 1] AS block FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(lines[i + 1]) <> '')"""
SQL_HEADING = r"(length(trim(block)) <= 80 AND regexp_matches(trim(block), '^[\p{Lu}\p{N}]') AND regexp_matches(trim(block), '\p{L}') AND NOT regexp_matches(trim(block), '[.!?:;,]$'))"
SQL_ELEMENTS = r"""(SELECT page_id, i AS pos, lower(regexp_extract(xs[i + 1], '^<(\w+)', 1)) AS tag,
    trim(regexp_replace(regexp_replace(xs[i + 1], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body
    FROM (SELECT page_id, xs, unnest(range(len(xs))) AS i FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'),
        '(?is)<(?:h[1-4]|p|li|dd)\b[^>]*>.*?</(?:h[1-4]|p|li|dd)>') AS xs FROM pages)))"""


@query(f"SELECT doc_id, md5({NORM}) AS hash, CAST(length({NORM}) AS BIGINT) AS n FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised text of each document, as a hash and a length."""
    norm = tx.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(norm).alias("hash"), LONG(F.length(norm)).alias("n"))


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and distinct words of each document."""
    w = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(tx.normalize(F.col("text"))).alias("w"))
    return w.select("doc_id", LONG(F.size("w")).alias("n_words"), LONG(F.size(F.array_distinct("w"))).alias("n_distinct"))


STOP = ", ".join(f"'{x}'" for x in tx.COMMON)
SQL_QUERY_WORDS = f"""(SELECT item_id, CASE WHEN len(u) > 0 THEN u[1:8] ELSE d[1:8] END AS words FROM (SELECT item_id, d, list_filter(d, lambda x: x NOT IN ({STOP})) AS u
    FROM (SELECT item_id, list_filter(f, lambda x, i: list_position(f, x) = i) AS d FROM (SELECT item_id, list_filter(regexp_extract_all({tx.sql_normalize("substr(text, 1, 200)")}, '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2) AS f FROM benchmark))))"""


@query(f"SELECT item_id, array_to_string(words, ' ') AS words, CAST(len(words) AS BIGINT) AS n FROM {SQL_QUERY_WORDS}")
def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a question searches for."""
    w = table(spark, sf_dir, "benchmark").select("item_id", tx.query_words(F.col("text")).alias("w"))
    return w.select("item_id", F.array_join("w", " ").alias("words"), LONG(F.size("w")).alias("n"))


@query(f"""SELECT item_id, CASE WHEN contains(p, ' ') THEN p END AS phrase FROM (SELECT item_id, trim(regexp_replace({tx.sql_normalize("substr(text, 1, 200)")}, '[^\\p{{L}}\\p{{N}}'']+', ' ', 'g')) AS p FROM benchmark)""")
def query_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question as one phrase; null for a single word."""
    return table(spark, sf_dir, "benchmark").select("item_id", tx.phrase(F.col("text")).alias("phrase"))


@query(f"SELECT doc_id, CAST(n AS BIGINT) AS hits, CAST(least(n, 10) AS BIGINT) AS capped FROM (SELECT doc_id, len(regexp_extract_all({NORM}, '(?:^|[^\\p{{L}}\\p{{N}}])th')) AS n FROM documents) WHERE n > 0")
def word_start_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that begin with the query word, and the count that scoring uses."""
    norm = table(spark, sf_dir, "documents").select("doc_id", tx.normalize(F.col("text")).alias("t"))
    return norm.select("doc_id", LONG(tx.hits(F.col("t"), "th")).alias("hits"), LONG(tx.hits(F.col("t"), "th", 10)).alias("capped")).where("hits > 0")


@query(f"""SELECT word, regexp_replace(word, '(es|s|e|x)$', '') AS stem_table, regexp_replace(word, '(es|s|x)$', '') AS stem_keyword, regexp_replace(word, '[sx]$', '') AS stem_heading
    FROM (SELECT DISTINCT unnest({WORDS}) AS word FROM benchmark)""")
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three stems, which differ by use: synonym table, keywords, headings."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(tx.tokens(tx.normalize(F.col("text")))).alias("word")).distinct()
    return w.select("word", F.regexp_replace("word", "(es|s|e|x)$", "").alias("stem_table"), F.regexp_replace("word", "(es|s|x)$", "").alias("stem_keyword"), F.regexp_replace("word", "[sx]$", "").alias("stem_heading"))


@query(f"SELECT doc_id, count(*) AS n_blocks, CAST(count_if({SQL_HEADING}) AS BIGINT) AS n_headings FROM {SQL_BLOCKS} GROUP BY doc_id")
def heading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each document and how many look like headings."""
    lines = tu.blocks(table(spark, sf_dir, "documents"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count_if(tu.is_heading()).alias("n_headings"))


@query(f"SELECT doc_id, shape, count(*) AS times FROM (SELECT doc_id, regexp_replace(lower(trim(block)), '[0-9]+', '#', 'g') AS shape FROM {SQL_BLOCKS}) GROUP BY doc_id, shape HAVING count(*) >= 3")
def repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines such as running headers, that repeat in a document."""
    return tu.repeated(tu.blocks(table(spark, sf_dir, "documents")))


@query(f"SELECT page_id, CAST(pos AS BIGINT) AS pos, tag, body FROM {SQL_ELEMENTS} WHERE tag IN ('p', 'li', 'dd') AND length(body) >= 60 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 150")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of at least 60 characters of each page, at most 150."""
    parts = tu.elements(table(spark, sf_dir, "pages")).where("tag in ('p', 'li', 'dd') and length(body) >= 60")
    at = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return parts.withColumn("n", at).where("n <= 150").select("page_id", LONG("pos").alias("pos"), "tag", "body")


@query(r"""SELECT page_id, title, CAST(length(body) AS BIGINT) AS n_chars, md5(body) AS hash FROM (SELECT page_id,
    trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<svg\b.*?</svg>|<template\b.*?</template>|<head\b.*?</head>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS body FROM pages)""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and visible text of each page."""
    body = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<svg\b.*?</svg>|<template\b.*?</template>|<head\b.*?</head>", " ")
    body = F.regexp_replace(body, "(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(a), F.lit(b))
    body = F.trim(F.regexp_replace(body, "[ \\t\\n\\r]+", " "))
    title = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), LONG(F.length(body)).alias("n_chars"), F.md5(body).alias("hash"))


@query(f"SELECT page_id, CAST(pos AS BIGINT) AS pos, last_value(CASE WHEN tag LIKE 'h_' THEN body END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS section FROM {SQL_ELEMENTS}")
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element of a page with the heading it stands under."""
    return tu.with_section(tu.elements(table(spark, sf_dir, "pages"))).select("page_id", LONG("pos").alias("pos"), "section")


@query(f"""SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS n_blocks, CAST(sum(size) AS BIGINT) AS tokens FROM (SELECT doc_id, size, floor((sum(size) OVER (PARTITION BY doc_id ORDER BY pos) - size) / 400) AS chunk
    FROM (SELECT doc_id, pos, CAST(ceil(length(block) / 4) AS BIGINT) AS size FROM {SQL_BLOCKS})) GROUP BY doc_id, chunk""")
def chunk_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks dealt into chunks by running size."""
    found = tu.packed_chunks(tu.blocks(table(spark, sf_dir, "documents")))
    return found.select("doc_id", LONG("chunk").alias("chunk"), "n_blocks", LONG("tokens").alias("tokens"))


@query()
def chunk_packer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact packer: a limit of 400 tokens, an overlap of 55, headings that close a chunk. A fold, so no SQL."""
    return tu.chunks(table(spark, sf_dir, "documents"))


@query(f"""SELECT doc_id, substr(text, greatest(1, place - 105), 420) AS excerpt FROM (SELECT doc_id, text, instr({NORM}, 'tion') AS place FROM documents) WHERE place > 0""")
def excerpt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """420 characters around the first hit, a quarter of them before it."""
    at = F.instr(tx.normalize(F.col("text")), "tion")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", at.alias("at")).where("at > 0")
    return docs.select("doc_id", F.expr("substr(text, greatest(1, at - 105), 420)").alias("excerpt"))


@query(r"""SELECT doc_id, CAST(length(c) AS BIGINT) AS n, md5(c) AS hash FROM (SELECT doc_id, CASE WHEN length(text) <= 700 THEN text WHEN length(s) > 350 THEN s ELSE substr(text, 1, 700) END AS c
    FROM (SELECT doc_id, text, regexp_extract(substr(text, 1, 700), '(?s)^(.*[.!?])[ \n]', 1) AS s FROM documents))""")
def sentence_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage cut at 700 characters, at the end of a sentence if that keeps over half."""
    s = F.regexp_extract(F.substring("text", 1, 700), "(?s)^(.*[.!?])[ \\n]", 1)
    c = F.when(F.length("text") <= 700, F.col("text")).when(F.length(s) > 350, s).otherwise(F.substring("text", 1, 700))
    return table(spark, sf_dir, "documents").select("doc_id", LONG(F.length(c)).alias("n"), F.md5(c).alias("hash"))


@query(f"""SELECT doc_id, substr(CASE WHEN s = '' THEN block ELSE s END, 1, 200) AS summary FROM (SELECT doc_id, block, regexp_extract(block, '^.*?[.!?](?: |$)') AS s FROM {SQL_BLOCKS}
    WHERE length(block) > 40 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1)""")
def provisional_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of the first block of over 40 characters; a null text has none."""
    first = F.filter(F.split("text", "\n"), lambda x: (F.length(x) > 40) & (F.trim(x) != ""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.get(first, F.lit(0)).alias("b")).where("b is not null")
    s = F.regexp_extract("b", "^.*?[.!?](?: |$)", 0)
    return docs.select("doc_id", F.substring(F.when(s == "", F.col("b")).otherwise(s), 1, 200).alias("summary"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{L}')) AS BIGINT) AS letters, len(regexp_extract_all(text, '\p{L}')) < 30 AS empty_page FROM documents")
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with so few letters that only a scan can explain it."""
    n = F.regexp_count("text", F.lit("\\p{L}"))
    return table(spark, sf_dir, "documents").select("doc_id", LONG(n).alias("letters"), (n < 30).alias("empty_page"))


def grams(name: str, key: str) -> str:
    return f"(SELECT {key}, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM (SELECT {key}, {WORDS} AS w FROM {name}) WHERE len(w) >= 5)"


@query(f"""SELECT doc_id, count(*) AS n_grams, count(b.g) AS n_found, round(count(b.g) / count(*), 6) AS ratio FROM {grams("documents", "doc_id")} a
    LEFT JOIN (SELECT DISTINCT g FROM {grams("benchmark", "item_id")}) b ON a.g = b.g GROUP BY doc_id""")
def copy_ratio_5gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a document's 5-grams that the passages of benchmark have."""
    own = lambda name, key: table(spark, sf_dir, name).select(key, F.explode(tu.ngrams(tx.tokens(tx.normalize(F.col("text"))))).alias("g"))
    there = own("benchmark", "item_id").select("g").distinct().withColumn("hit", F.lit(True))
    counts = own("documents", "doc_id").join(there, "g", "left").groupBy("doc_id").agg(F.count("*").alias("n_grams"), F.count("hit").alias("n_found"))
    return counts.withColumn("ratio", F.round(F.col("n_found") / F.col("n_grams"), 6))


SQL_TURNS = "(SELECT conv_id, turn, text, role, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations)"


@query(rf"""SELECT conv_id, turn, CAST(len(list_filter(list_distinct(regexp_extract_all(regexp_replace(text, '\[[0-9]+\]', '', 'g'), '[0-9]+')), lambda x: NOT list_contains(regexp_extract_all(coalesce(asked, ''), '[0-9]+'), x))) AS BIGINT) AS n_unsupported
    FROM {SQL_TURNS} WHERE role = 'assistant'""")
def figures_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of an answer that the question before it does not have; references such as [1] do not count."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("asked", F.lag("text").over(w)).where("role = 'assistant'")
    found = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    extra = F.array_except(found(F.regexp_replace("text", "\\[[0-9]+\\]", "")), found(F.coalesce("asked", F.lit(""))))
    return turns.select("conv_id", "turn", LONG(F.size(extra)).alias("n_unsupported"))


@query("SELECT conv_id, role, max(turn) AS turn, md5(arg_max(text, turn)) AS hash FROM conversations GROUP BY conv_id, role")
def conversation_last_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last question and the last answer of each conversation."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max("turn").alias("turn"), F.md5(F.max_by("text", "turn")).alias("hash"))


@query(f"""SELECT conv_id, turn, n_words < 5 OR useful = 0 AS needs_context FROM (SELECT conv_id, turn, len(w) AS n_words, len(list_filter(w, lambda x: length(x) >= 3 AND x NOT IN ({STOP}))) AS useful FROM (SELECT conv_id, turn, {WORDS} AS w FROM conversations WHERE role = 'user'))""")
def needs_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions too short or too empty to be searched without the conversation before them."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", tx.tokens(tx.normalize(F.col("text"))).alias("w"))
    useful = F.size(F.filter("w", lambda x: (F.length(x) >= 3) & ~x.isin(tx.COMMON)))
    return turns.select("conv_id", "turn", ((F.size("w") < 5) | (useful == 0)).alias("needs_context"))


@query(rf"""SELECT conv_id, turn, CAST(length(t) AS BIGINT) AS n, md5(t) AS hash, length(t) BETWEEN 1 AND 500 AS accepted FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f\x{{202a}}-\x{{202e}}\x{{2066}}-\x{{2069}}]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS t FROM conversations)""")
def message_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without control and direction marks, at most two line ends in a row; 1 to 500 characters are accepted."""
    t = F.trim(F.regexp_replace(F.regexp_replace("text", "[\\x00-\\x08\\x0b-\\x1f\\x7f\\u202a-\\u202e\\u2066-\\u2069]", ""), "\\n{3,}", "\n\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", LONG(F.length(t)).alias("n"), F.md5(t).alias("hash"), F.length(t).between(1, 500).alias("accepted"))


@query(f"SELECT doc_id, term, CAST(tf AS BIGINT) AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY doc_id, term) WHERE tf >= 20")
def frequent_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the words that a document has 20 times or more."""
    return tu.postings(table(spark, sf_dir, "documents"), "doc_id", "text").where("tf >= 20")
