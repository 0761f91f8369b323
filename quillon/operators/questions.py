"""What is searched for a question: a table of everyday expressions gives search terms, the question's own long words follow.

An expression is found where all its meaningful words are in the question, in any order; one that keeps a single meaningful word of
several must stand there as written. Expressions with more and longer words come first; one that brings no word of its own is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import lexicon as lx
from quillon.functions import text as tx
from quillon.functions.rules import ENDING

# Words that never make an expression; how many searches a question makes, how many of them by terms of the table, and
# from how many letters one of its own words makes one.
SMALL = """a ai as au aux avec c ce cet cette d de des du elle en est et il j je l la le les leur lui m ma me mes mon
    n ne on ont ou par pour qu que qui s sa se ses son sur t ta te tes ton tu un une y vous nous""".split()
SEARCHES, BY_TABLE, LONG = 6, 3, 4
NONE = "cast(array() as array<string>)"


def stem(word: Column) -> Column:
    return F.regexp_replace(word, ENDING, "")


def patterns(entries: DataFrame) -> DataFrame:
    """(entry, nth, stems, exact, n, size, search, also, theme): one row for each expression of a table.

    entries (entry, said, search, also, theme): expressions ``said`` and the terms to search, arrays. Blank terms go; an entry
    without a term, and an expression without a meaningful word, have no row. exact is null unless the expression must stand as
    written; n is the number of stems, size their letters and the blanks between."""
    filled = lambda c: F.filter(F.coalesce(c, F.expr(NONE)), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    own = entries.select("entry", "said", filled("search").alias("search"), filled("also").alias("also"), F.coalesce("theme", F.lit("")).alias("theme")).where("size(search) > 0")
    each = own.select("entry", "search", "also", "theme", F.posexplode("said").alias("nth", "said")).withColumn("words", lx.words_of(F.col("said")))
    each = each.withColumn("stems", F.array_distinct(F.transform(F.filter("words", lambda x: ~x.isin(SMALL)), stem))).where("size(stems) > 0")
    exact = F.when((F.size("words") > 1) & (F.size("stems") == 1), F.array_join("words", " "))
    return each.select("entry", "nth", "stems", exact.alias("exact"), F.size("stems").alias("n"), F.length(F.array_join("stems", " ")).alias("size"), "search", "also", "theme")


def matches(asked: DataFrame, key: str, text: str, table: DataFrame) -> DataFrame:
    """(key, entry, nth, n, size, search, also, theme): the expressions of patterns() in each text that bring a word of their own.

    Texts and expressions meet in an equi-join on the expression's rarest stem in the table. One left out brings no word, so one stays
    exactly if it is the first with one of its words: an aggregation, no pass in order. ``key`` is unique in asked."""
    spread = table.select(F.explode("stems").alias("stem")).groupBy("stem").agg(F.count("*").alias("times"))
    each = table.select("entry", "nth", F.explode("stems").alias("stem")).join(spread, "stem")
    entrance = each.groupBy("entry", "nth").agg(F.min_by("stem", F.struct("times", "stem")).alias("stem"))
    rows = asked.select(F.col(key).alias("_key"), lx.words_of(F.col(text)).alias("_words")).withColumn("_stems", F.array_distinct(F.transform("_words", stem)))
    found = rows.withColumn("stem", F.explode("_stems")).join(table.join(entrance, ["entry", "nth"]), "stem").where(F.size(F.array_except("stems", "_stems")) == 0)
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    found = found.where(F.col("exact").isNull() | F.contains(padded(F.array_join("_words", " ")), padded(F.col("exact"))))
    told = F.struct((-F.col("n")).alias("a"), (-F.col("size")).alias("b"), "entry", "nth", "search", "also", "theme")
    first = found.select("_key", F.explode("stems").alias("word"), told.alias("x")).groupBy("_key", "word").agg(F.min("x").alias("x"))
    return first.select("_key", "x").distinct().select(F.col("_key").alias(key), "x.entry", "x.nth", (-F.col("x.a")).alias("n"), (-F.col("x.b")).alias("size"), "x.search", "x.also", "x.theme")


def understood(asked: DataFrame, key: str, text: str, table: DataFrame) -> DataFrame:
    """asked's (key, text) with term, search, also, themes, each question's terms from patterns(), the most precise expression's first.

    term is the first search term, null where no expression is found; also has none of search. A question has no more
    expressions than words, so the lists stay small."""
    told = F.struct((-F.col("n")).alias("a"), (-F.col("size")).alias("b"), "entry", "nth", "search", "also", "theme")
    best = matches(asked, key, text, table).groupBy(key, "entry").agg(F.min(told).alias("x"))
    lists = best.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("_x"))
    flat = lambda c: F.array_distinct(F.flatten(F.transform(F.coalesce("_x", F.lit([]).cast(lists.schema["_x"].dataType)), lambda x: x[c])))
    rows = asked.select(key, text).join(lists, key, "left").withColumn("search", flat("search"))
    themes = F.coalesce(F.array_distinct(F.transform("_x", lambda x: x["theme"])), F.expr(NONE))
    return rows.select(key, text, F.get("search", F.lit(0)).alias("term"), "search", F.array_except(flat("also"), F.col("search")).alias("also"), themes.alias("themes"))


def prepared(known: DataFrame, text: str) -> DataFrame:
    """known, a result of understood(), with searches and vector_text.

    searches: the question, three terms of the table, then the question's own useful words of four letters or more that no term
    has, as typed, the longest first; six in all. vector_text: the question with all terms in brackets. A null question is empty."""
    question = F.coalesce(text, F.lit(""))
    covered = F.flatten(F.transform("search", lx.useful_words))
    own = F.filter(F.regexp_extract_all(question, F.lit(tx.WORD), F.lit(0)), lambda x: F.length(x) >= LONG)
    both = F.struct(F.array_except(lx.useful_words(question), covered).alias("useful"), F.array_distinct(own).alias("own"))
    typed = tx.once(both, lambda x: F.filter(x["own"], lambda w: F.array_contains(x["useful"], tx.normalize(w))))
    rows = known.withColumn("_own", typed)
    placed = F.transform("_own", lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("w")))
    single = F.transform(F.sort_array(placed), lambda x: x["w"])
    searches = F.slice(F.concat(F.array(question), F.slice("search", 1, BY_TABLE), single), 1, SEARCHES)
    vector = F.when(F.size("search") > 0, F.concat(question, F.lit(" ("), F.array_join("search", ", "), F.lit(")"))).otherwise(question)
    return rows.select(*known.columns, searches.alias("searches"), vector.alias("vector_text"))


def all_words(searches: Column, most: int = 16) -> Column:
    """The words that several searches ask for, each once, in order, at most sixteen."""
    return F.slice(F.array_distinct(F.flatten(F.transform(searches, tx.query_words))), 1, most)
