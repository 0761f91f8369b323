"""Cleaning of pages and blocks, phrases of a dictionary in questions, keyword search by section, longest prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import lexicon as lx
from quillon.functions import text as tx
from quillon.operators import block_fold, html_clean, phrases
from quillon.operators.text_units import format_blocks
from quillon.plans.registry import query
from quillon.session import kept, spread, table
from quillon.sources import extract

W = "[\\p{L}\\p{N}]+"


@query()
def html_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the white-list cleaner: HTML, sections, what was rejected. Links to another page of the table become local ones. A state machine, so no SQL."""
    pages = spread(table(spark, sf_dir, "pages"))
    slug = F.regexp_extract("url", r"([^/?#]+)/*(?:[?#].*)?$", 1)
    known = pages.select(slug.alias("slug"), F.regexp_extract("url", "^https?://[^/]+/([^/?#]+)", 1).alias("category")).groupBy("slug").agg(F.min("category").alias("category"))
    found = html_clean.cleaned(pages.withColumn("slug", slug), "page_id", "html", "slug", known)
    told = F.transform("sections", lambda x: F.concat(x["title"], F.lit(": "), x["text"]))
    return found.select("page_id", "html", F.size("sections").alias("n_sections"), F.array_join(told, "\n\n").alias("text"), F.array_join(F.sort_array("rejected"), ",").alias("rejected"))


@query()
def block_fold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' blocks after the clean-up: headers, page numbers, figures that wait, short blocks joined, headings in a row. A fold, so no SQL."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    text = F.trim(F.regexp_replace("text", "[ \\t\\u00a0]+", " "))
    heading = (F.length("text") <= 80) & F.col("text").rlike("^[\\p{Lu}0-9]") & F.col("text").rlike("\\p{L}") & ~F.col("text").rlike("[.,;:!?…)]$")
    rows = rows.withColumn("text", text).withColumn("heading", heading).withColumn("guessed", heading).withColumn("page", (F.col("pos") / 40).cast("int"))
    return block_fold.folded(rows, "doc_id")


@query("""SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN h <> '' THEN h END AS chapter FROM (SELECT doc_id, pos, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS h FROM
    (SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^[A-ZÀ-Ý][^.]*$') THEN line WHEN trim(line) = '' THEN '' END AS h FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))))""")
def chapter_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the chapter it is in: a line without a full stop begins one, an empty line says there is none, others say nothing."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    header = F.when(F.col("line").rlike("^[A-ZÀ-Ý][^.]*$"), F.col("line")).when(F.trim("line") == "", F.lit(""))
    return block_fold.chapters(rows.withColumn("header", header), "doc_id", "pos", "header").select("doc_id", "pos", "chapter")


# --- phrases in questions: articles are the benchmark's items, questions the users' turns --------------------------------------------
def sql_words(column: str) -> str:
    return f"regexp_extract_all({tx.sql_normalize(column)}, '{W}')"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in words) + "]"


NOUN = f"(regexp_matches(x, '^\\p{{L}}{{3,}}$') AND NOT list_contains({sql_list(lx.NEVER)}, x))"
STEMS = "list_transform(CASE WHEN len(u) > 0 THEN u ELSE w END, lambda x: regexp_replace(x, '(es|s|x)$', ''))"
TURNS = f"SELECT conv_id * 1000 + turn AS question, {sql_words('text')} AS w FROM conversations WHERE role = 'user'"
ARTICLES = f"SELECT item_id AS article, {sql_words('text')} AS w FROM benchmark"
KEYS = f"""keys AS (SELECT article, unnest([[w[1]], w[2:3], w[1:3], w[4:4]]) AS w, unnest([0, 1, 2, 3]) AS nth FROM ({ARTICLES}) WHERE len(w) >= 4)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question"), "text")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item with four keywords from its first words."""
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("article"), tx.tokens(tx.normalize(F.col("text"))).alias("w")).where("size(w) >= 4")
    keyword = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    return w.select("article", F.array(keyword(1, 1), keyword(2, 2), keyword(1, 3), keyword(4, 1)).alias("keywords"))


STRENGTH = f"""{KEYS}, key AS (SELECT article, nth, array_to_string(w, ' ') AS phrase, len(list_filter(w, lambda x: {NOUN} OR regexp_matches(x, '^[0-9]+$'))) AS sense, {STEMS} AS stems
      FROM (SELECT *, list_filter(w, lambda x: length(x) >= 3 AND NOT list_contains({sql_list(lx.EMPTY)}, x)) AS u FROM keys)),
    turn AS (SELECT question, ' ' || array_to_string(w, ' ') || ' ' AS form, {STEMS} AS stems FROM (SELECT *, list_filter(w, lambda x: length(x) >= 3 AND NOT list_contains({sql_list(lx.EMPTY)}, x)) AS u FROM ({{questions}}))),
    pair AS (SELECT question, article, nth, phrase, sense, turn.stems AS own, key.stems AS theirs FROM turn JOIN key ON contains(form, ' ' || phrase || ' ') WHERE length(phrase) >= 2),
    share AS (SELECT *, CASE WHEN len(own) > 0 THEN len(list_filter(own, lambda x: list_contains(theirs, x)))::DOUBLE / len(own) ELSE 0 END AS share FROM pair),
    strength AS (SELECT question, article, phrase AS keyword, CASE WHEN sense >= 2 OR share >= 2 / 3 THEN 'complete' ELSE 'moderate' END AS level, round(share, 2) AS coverage, CASE WHEN sense >= 2 THEN 0.25::DOUBLE ELSE 0.35::DOUBLE END AS floor FROM share
      QUALIFY row_number() OVER (PARTITION BY question, article ORDER BY sense >= 2 OR share >= 2 / 3 DESC, length(phrase) DESC, nth) = 1)"""


@query(f"WITH {STRENGTH.replace("{questions}", TURNS)} SELECT question, article, keyword, level, coverage, floor FROM strength")
def keyword_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best keyword of each article that a question has whole, complete or moderate, with its coverage and the cosine that contradicts it."""
    return phrases.keyword_strength(asked(spark, sf_dir), "question", "text", articles(spark, sf_dir), "article", "keywords")


@query(f"""WITH t AS (SELECT DISTINCT unnest([w[1:1], w[2:3], w[3:5]]) AS w FROM ({ARTICLES})), title AS (SELECT array_to_string(w, ' ') AS title FROM t WHERE len(w) > 0 AND length(array_to_string(w, '')) >= 4
      AND NOT list_contains({sql_list(lx.NO_START)}, w[1]) AND len(list_filter(w, lambda x: {NOUN})) > 0),
    turn AS (SELECT question, ' ' || array_to_string(w, ' ') || ' ' AS form FROM ({TURNS}))
    SELECT question, title FROM turn JOIN title ON contains(form, ' ' || title || ' ') QUALIFY row_number() OVER (PARTITION BY question ORDER BY length(title) DESC, title DESC) = 1""")
def title_in_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest title that a question contains word for word and that can be its subject."""
    w = table(spark, sf_dir, "benchmark").select(tx.tokens(tx.normalize(F.col("text"))).alias("w"))
    titles = w.select(F.explode(F.array(F.slice("w", 1, 1), F.slice("w", 2, 2), F.slice("w", 3, 3))).alias("t")).select(F.array_join("t", " ").alias("title"))
    return phrases.longest_title(asked(spark, sf_dir), "question", "text", titles, "title")


ITEMS = f"SELECT item_id AS question, {sql_words('text')} AS w FROM benchmark"
LIST = "'[\\p{L}\\p{N}]+'"
SQL_SEARCH = f"""WITH doc AS (SELECT doc_id AS article, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
    keys AS (SELECT article, unnest([w[1:2], w[1:3]]) AS w, unnest([0, 1]) AS nth FROM (SELECT article, {sql_words("l[1]")} AS w FROM doc WHERE len(l) > 0)),
    {STRENGTH.replace(KEYS + ", ", "").replace("{questions}", ITEMS)},
    raw AS (SELECT article, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS section, left(l[1], 40) AS title FROM doc),
    sec AS (SELECT article, section, regexp_replace({tx.sql_normalize("line")}, ' +', ' ', 'g') AS norm, {tx.sql_normalize("title || ' ' || array_to_string(string_split(line, ' ')[1:2], ' ')")} AS titles FROM raw),
    tok AS (SELECT article, section, norm, regexp_extract_all(norm, {LIST}) AS a, regexp_extract_all(titles, {LIST}) AS b FROM sec),
    q AS (SELECT question, words, phrase FROM (SELECT item_id AS question, trim(regexp_replace({tx.sql_normalize("substr(text, 1, 200)")}, '[^\\p{{L}}\\p{{N}}'']+', ' ', 'g')) AS phrase FROM benchmark) JOIN
      (SELECT item_id AS question, (CASE WHEN len(useful) > 0 THEN useful ELSE d END)[1:8] AS words FROM (SELECT item_id, d, list_filter(d, lambda x: NOT list_contains({sql_list(tx.COMMON)}, x)) AS useful FROM
      (SELECT item_id, list_filter(f, lambda x, i: list_position(f, x) = i) AS d FROM (SELECT item_id, list_filter({sql_words("substr(text, 1, 200)")}, lambda x: length(x) >= 2) AS f FROM benchmark)))) USING (question)),
    term AS (SELECT article, section, t, count(*) FILTER (w = 0) AS hits, max(w) AS titled FROM (SELECT article, section, unnest(a) AS t, 0 AS w FROM tok UNION ALL SELECT article, section, unnest(b), 1 FROM tok) GROUP BY ALL),
    word AS (SELECT DISTINCT unnest(words) AS word FROM q),
    held AS (SELECT word, article, section, least(sum(hits), 10) AS hits, max(titled) AS titled FROM term JOIN word ON starts_with(t, word) GROUP BY ALL),
    met AS (SELECT question, article, section, count(*) AS met, sum(CASE WHEN hits > 0 THEN hits ELSE titled END) AS hits, sum(titled) AS titled FROM (SELECT question, unnest(words) AS word FROM q) JOIN held USING (word) GROUP BY ALL),
    cand AS (SELECT question, article, section, met, hits, titled FROM met UNION SELECT s.question, s.article, section, 0, 0, 0 FROM strength s JOIN sec USING (article) WHERE level = 'complete' AND NOT EXISTS (SELECT 1 FROM met m WHERE m.question = s.question AND m.article = s.article AND m.section = sec.section)),
    score AS (SELECT question, article, section, CASE level WHEN 'complete' THEN 1000 WHEN 'moderate' THEN 3 ELSE 0 END + hits + CASE WHEN contains(phrase, ' ') AND contains(norm, phrase) THEN 15 ELSE 0 END + 5 * titled AS score
      FROM cand JOIN q USING (question) JOIN sec USING (article, section) LEFT JOIN strength USING (question, article) WHERE met = len(words) OR coalesce(level, '') = 'complete'),
    best AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY question, article ORDER BY score DESC, section) = 1)
    SELECT question, article, CAST(section AS INT) AS section, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, article) AS INT) AS rank FROM best QUALIFY rank <= 5"""


@query(SQL_SEARCH)
def section_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five articles for each benchmark item, each by its best section: documents are articles, their lines sections, their first words keywords."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("article"), F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "").alias("l"))
    title = tx.normalize(F.coalesce(F.left(F.get("l", F.lit(0)), F.lit(40)), F.lit("")))
    rows = docs.select("article", title.alias("title"), F.posexplode("l").alias("section", "line"))
    titles = F.concat("title", F.lit(" "), tx.normalize(F.substring_index("line", " ", 2)))
    sections = kept(rows.select("article", "section", F.regexp_replace(tx.normalize(F.col("line")), " +", " ").alias("norm"), titles.alias("titles")), "sections")
    begin = F.regexp_extract("norm", f"^(?:[^\\p{{L}}\\p{{N}}]*{W}){{1,3}}", 0)  # three words at most
    w = sections.where("section = 0").select("article", tx.tokens(begin).alias("w"))
    keys = w.select("article", F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 1, 3), " ")).alias("keywords"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), "text")
    strength = phrases.keyword_strength(items, "question", "text", keys, "article", "keywords")
    q = items.select("question", tx.query_words(F.col("text")).alias("words"), tx.phrase(F.col("text")).alias("phrase"))
    return phrases.section_search(q, sections, strength, 5)


@query("""WITH p AS (SELECT DISTINCT unnest([regexp_extract(url, '^https?://[^/]+/'), regexp_extract(url, '^https?://[^/]+/[^/]+/')]) AS prefix FROM pages WHERE page_id % 2 = 0)
    SELECT page_id, url, prefix, length(prefix) AS size FROM pages LEFT JOIN p ON prefix <> '' AND starts_with(url, prefix) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC NULLS LAST) = 1""")
def content_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL with the longest known prefix; known are the hosts and first folders of every second page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    known = pages.where("page_id % 2 = 0").select(F.explode(F.array(F.regexp_extract("url", "^https?://[^/]+/", 0), F.regexp_extract("url", "^https?://[^/]+/[^/]+/", 0))).alias("prefix")).where("prefix <> ''").distinct()
    return phrases.longest_prefix(pages, "url", known.withColumn("size", F.length("prefix")), "prefix")


def _sql_unescaped(text: str) -> str:
    """SQL for the named entities; the ampersand's own comes last."""
    for name in [x for x in extract.ENTITIES if x != "amp"] + ["amp"]:
        text = f"replace({text}, '&{name};', chr({ord(extract.html5[name + ';'])}))"
    return text


_HIDDEN = "|".join(rf"<{x}\b.*?</{x}\s*>" for x in extract.HIDDEN.split("|"))
_PAGE_TEXT = _sql_unescaped(rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|{_HIDDEN}', ' ', 'g'),
    '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>', chr(10) || chr(10) || chr(1) || '\1' || chr(10) || chr(10), 'g'), '(?i)</({"|".join(extract.ENDS)})\s*>', chr(10) || chr(10), 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)<li\b[^>]*>', '• ', 'g'), '<[^>]+>', ' ', 'g')""")


@query(rf"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INT) AS pos, md5(trim(replace(p, chr(1), ''))) AS hash, starts_with(p, chr(1)) AS heading
    FROM (SELECT page_id, k, trim(regexp_replace(replace(part, chr(10), ' '), '[ \t\x{{a0}}]+', ' ', 'g')) AS p FROM (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM (SELECT page_id, string_split_regex({_PAGE_TEXT}, '\n\s*\n') AS parts FROM pages)))
    WHERE trim(replace(p, chr(1), '')) <> ''""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and paragraphs of each page in order, entities read, scripts and the like left out."""
    found = format_blocks(spread(table(spark, sf_dir, "pages")), "page_id", "html", "html")
    return found.select("page_id", "pos", F.md5("text").alias("hash"), "heading")


@query(r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS pos, md5(regexp_replace(p, '[ \t\x{a0}]+', ' ', 'g')) AS hash, length(p) <= 80 AND regexp_matches(p, '\p{L}') AND NOT regexp_matches(p, '[.,;:!?…)]$') AND regexp_matches(p, '^[\p{Lu}0-9]') AS heading
    FROM (SELECT doc_id, k, regexp_replace(line, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL))
    WHERE p <> '' AND NOT regexp_matches(p, '^[0-9]+$')""")
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each document, every line being one: lone numbers are left out, short lines without a final mark are headings."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return format_blocks(docs, "doc_id", "text", "txt").select("doc_id", "pos", F.md5("text").alias("hash"), "heading")
