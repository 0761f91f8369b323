"""Phrases of a dictionary in texts: word n-grams of the dictionary's own lengths meet it in an equi-join; no pair of text and entry is tried.

On it rest the keywords of articles found in questions, titles that a question contains, keyword search by section, and the
longest prefix of a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import lexicon as lx
from quillon.functions import text as tx
from quillon.session import kept


def found(texts: DataFrame, words: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """texts x phrases where the words of ``phrase`` (array<string>, not empty) stand together among ``words``; a row for each pair of rows.

    The dictionary's lengths, in words, are the only thing that passes the driver; a text of n words sends at most n n-grams for
    each length, equal ones once."""
    lengths = sorted(r[0] for r in phrases.select(F.size(phrase)).distinct().collect() if r[0] and r[0] > 0)
    grams = [F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda at: F.array_join(F.slice(words, at, F.lit(size)), " ")) for n in lengths for size in [n]]
    made = [F.when(F.size(words) >= n, g).otherwise(F.expr("cast(array() as array<string>)")) for n, g in zip(lengths, grams, strict=True)]
    own = texts.withColumn("_gram", F.explode(F.array_distinct(F.concat(*made)) if made else F.expr("cast(array() as array<string>)")))
    return own.join(phrases.withColumn("_gram", F.array_join(phrase, " ")), "_gram").drop("_gram")


def longest_title(asked: DataFrame, key: str, text: str, titles: DataFrame, title: str) -> DataFrame:
    """(key, title): the longest of the titles that a text contains word for word, brackets left out; only those that can be a subject, equal lengths by their letters.

    A text without one gives no row."""
    own = titles.select(lx.words_of(F.col(title), brackets=False).alias("_words")).where(lx.nominal_title(F.col("_words"))).distinct()
    hits = found(asked.select(key, lx.words_of(F.col(text)).alias("_text")), "_text", own, "_words").select(key, F.array_join("_words", " ").alias("title"))
    return hits.groupBy(key).agg(F.max_by("title", F.struct(F.length("title"), F.col("title"))).alias("title"))


def keyword_strength(asked: DataFrame, key: str, text: str, articles: DataFrame, article: str, keywords: str) -> DataFrame:
    """(key, article, keyword, level, coverage, floor): the best keyword of each article that stands whole in a text.

    ``complete``: two words that carry a meaning, or two thirds of the text's useful words; else ``moderate``. Complete ones first, then
    the longest, then the first. floor is the cosine below which a vector contradicts it: 0.25 for two words that carry a meaning, else 0.35."""
    each = articles.select(F.col(article).alias("article"), F.posexplode(keywords).alias("at", "keyword"))
    each = each.select("*", lx.words_of(F.col("keyword")).alias("words"), lx.useful_stems(F.col("keyword")).alias("stems")).where(F.length(F.array_join("words", " ")) >= 2)
    each = each.withColumn("sense", F.size(F.filter("words", lx.carries)))
    rows = asked.select(F.col(key).alias("key"), lx.words_of(F.col(text)).alias("_text"), lx.useful_stems(F.col(text)).alias("_stems"))
    hits = found(rows, "_text", each, "words")
    share = F.when(F.size("_stems") > 0, F.size(F.filter("_stems", lambda x: F.array_contains("stems", x))) / F.size("_stems")).otherwise(F.lit(0.0))
    hits = hits.withColumn("share", share)
    complete = (F.col("sense") >= 2) | (F.col("share") >= 2 / 3)
    told = F.struct(F.col("keyword").alias("keyword"), F.when(complete, "complete").otherwise("moderate").alias("level"), F.round("share", 2).alias("coverage"), F.when(F.col("sense") >= 2, F.lit(0.25)).otherwise(0.35).alias("floor"))
    order = F.struct(complete, F.length(F.array_join("words", " ")), -F.col("at"))
    best = hits.groupBy("key", "article").agg(F.max_by(told, order).alias("x"))
    return best.select(F.col("key").alias(key), "article", "x.*")


def starting(words: DataFrame, word: str, terms: DataFrame, term: str) -> DataFrame:
    """(word, term, other columns of terms) of distinct words and the terms that they begin: each term, distinct in its table, stands
    under all its beginnings, as long as some word is, and meets the words in an equi-join."""
    words = words.select(F.col(word).alias("word")).distinct()
    longest = words.agg(F.coalesce(F.max(F.length("word")), F.lit(0))).first()[0]
    ends = F.when(F.least(F.length(term), F.lit(longest)) >= 1, F.sequence(F.lit(1), F.least(F.length(term), F.lit(longest))))
    each = terms.withColumn("_end", F.explode(ends)).withColumn("word", F.left(term, F.col("_end")))
    return each.join(words, "word").select("word", F.col(term).alias("term"), *[c for c in terms.columns if c != term])


def section_search(asked: DataFrame, sections: DataFrame, strength: DataFrame, k: int = 5) -> DataFrame:
    """(question, article, score, section, rank): the best section of each article for each question, k articles a question.

    asked (question, words, phrase), sections (article, section, norm, titles: normalised texts; read several times), strength of
    keyword_strength() by question. A section has every word of the question at the start of its own words or those of its titles, unless
    a complete keyword speaks for its article. Score: 1000 or 3 for a complete or moderate keyword, each word's hits up to ten (or one in
    the titles), 15 for the whole phrase, 5 for each word in the titles. Sections come from each question's rarest word and meet their
    texts once; there the question's other words are looked up, so no list of a common word is made.
    """
    strength = kept(strength.select("question", "article", "level"), "strength")
    words = asked.select("question", F.explode("words").alias("word"))
    terms = sections.select("article", "section", F.explode(tx.tokens(F.concat_ws(" ", "norm", "titles"))).alias("term"))
    pairs = kept(starting(words, "word", terms.groupBy("term").agg(F.count("*").alias("n")), "term"), "pairs")
    rare = pairs.groupBy("word").agg(F.sum("n").alias("n"))
    first = words.join(rare, "word", "left").groupBy("question").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), F.col("word"))).alias("word"))
    entries = kept(first.join(pairs, "word").select("question", "term"), "entries")
    complete = strength.where("level = 'complete'").join(sections.select("article", "section"), "article")
    candidates = terms.join(entries, "term").select("question", "article", "section", F.lit(False).alias("complete"))
    candidates = candidates.union(complete.select("question", "article", "section", F.lit(True))).groupBy("question", "article", "section").agg(F.max("complete").alias("complete"))

    none = F.array().cast("array<string>")
    own = asked.select("question", F.transform(F.coalesce("words", none), lambda w: F.nullif(w, F.lit(""))).alias("words"), "phrase")
    rows = candidates.join(sections, ["article", "section"]).join(own, "question")
    begun = lambda of, w, c: F.when(F.contains(c, w), F.size(F.filter(of, lambda x: F.startswith(x, w)))).otherwise(0)
    count = lambda of: F.transform("words", lambda w: F.struct(begun(of[0], w, "norm").alias("hits"), F.least(begun(of[1], w, "titles"), F.lit(1)).alias("titled")))
    held = tx.once(F.array(*[F.coalesce(tx.tokens(F.col(c)), none) for c in ("norm", "titles")]), count)
    whole = F.when(F.coalesce(F.contains("norm", F.col("phrase")), F.lit(False)), 15).otherwise(0)
    # the join has dealt the rows by section, so these groups, of one row but for sections in several rows, need no shuffle
    each = rows.select("question", "article", "section", "complete", whole.alias("whole"), F.posexplode_outer(held).alias("at", "held"))
    each = each.groupBy("question", "article", "section", "at").agg(F.least(F.sum("held.hits"), F.lit(10)).alias("hits"), F.max("held.titled").alias("titled"), *[F.max(c).alias(c) for c in ("complete", "whole")])
    score = F.sum(F.when(F.col("hits") > 0, F.col("hits")).otherwise(F.col("titled")) + 5 * F.col("titled"))
    found = each.groupBy("question", "article", "section").agg(F.count_if(F.col("at").isNotNull() & (F.col("hits") + F.col("titled") == 0)).alias("missed"), F.max("complete").alias("complete"), (F.coalesce(score, F.lit(0)) + F.max("whole")).alias("score"))
    scored = found.where(F.col("complete") | (F.col("missed") == 0)).select("question", "article", "section", "score")
    best = scored.groupBy("question", "article").agg(F.max_by(F.struct("score", "section"), F.struct(F.col("score"), -F.col("section"))).alias("x"))
    base = F.when(F.col("level") == "complete", 1000).when(F.col("level") == "moderate", 3).otherwise(0)
    best = best.join(strength, ["question", "article"], "left").select("question", "article", (base + F.col("x.score")).alias("score"), "x.section")
    order = Window.partitionBy("question").orderBy(F.desc("score"), "article")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def longest_prefix(df: DataFrame, path: str, prefixes: DataFrame, prefix: str, mark: str = "/") -> DataFrame:
    """df with the columns of the row of prefixes whose ``prefix``, which ends with ``mark``, is the longest that ``path`` begins with; null where there is none.

    A path stands under each of its beginnings that ends with the mark and meets the prefixes in an equi-join; rows of df must be distinct, prefixes unique."""
    parts = F.split(path, f"\\Q{mark}\\E")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), mark), F.lit(mark)))
    each = df.withColumn("_begin", F.explode_outer(F.when(F.size(parts) > 1, begins)))
    rest = [c for c in prefixes.columns if c != prefix]
    both = each.join(prefixes.select(F.col(prefix).alias("_begin"), F.struct(F.col(prefix), *rest).alias("_x")), "_begin", "left")
    best = both.groupBy(*df.columns).agg(F.max_by("_x", F.when(F.col("_x").isNotNull(), F.length("_begin"))).alias("_x"))
    return best.select(*df.columns, "_x.*")
