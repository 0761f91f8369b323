"""Ranking of the few passages that a question has found: BM25 with title and section rules, keyword promotion, merge, choice for the model.

Each takes rows of many questions at once; a question's passages are a handful, so windows by question stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import lexicon as lx
from quillon.functions import text as tx
from quillon.operators.retrieval import K1, B, cap

# Factors and additions of the rules on titles and sections; a section's share for each word in its heading; the weight
# of neighbouring terms; letters from which a word also finds longer ones.
FACTOR = {"exact": 3.0, "begins": 1.8, "special": 2 / 3, "general": 1.4}
ADDED = {"exact": 0.15, "special": -0.05, "general": 0.03}
IN_SECTION, SECONDARY, LONG = 0.5, 0.5, 5
# Cosine from which a moderate keyword stands on one word, its bonus; how far below the best a passage may be.
ALONE, BONUS, GAP = 0.35, 0.05, 0.1


def _fits(found: Column, asked: Column) -> Column:
    return (found == asked) | ((F.length(asked) >= LONG) & F.startswith(found, asked))


def relation(title: Column, term: Column) -> Column:
    """struct(kind, extras): how a normalised title stands to a normalised term (exact, begins: with one more word at most, special, none), and its words that the term lacks."""

    def of(t: Column) -> Column:
        extras = F.filter(F.split(t, " "), lambda x: (x != "") & ~F.array_contains(F.split(term, " "), x))
        starts = F.startswith(t, F.concat(term, F.lit(" ")))
        kind = F.when((t == "") | (F.coalesce(term, F.lit("")) == ""), "none").when(t == term, "exact").when(starts & (F.size(extras) <= 1), "begins").when(F.contains(t, term), "special").otherwise("none")
        return F.struct(kind.alias("kind"), extras.alias("extras"))

    return tx.once(F.trim(F.regexp_replace(tx.normalize(F.coalesce(title, F.lit(""))), " +", " ")), of)


def reranked(passages: DataFrame, asked: DataFrame, n: int = 10) -> DataFrame:
    """(question, passage, score, raw, adjustment, rank): the n best passages of each question with a score above 0.

    passages (question, passage, title, section, text, keys), keys being lexicon.useful_keys() of the source or null; asked (question, words,
    neighbours, term): words at weight 1, neighbours (less the words) at half weight, term the normalised subject or null. raw is
    BM25 over title, section, text and keys among the question's own passages, and half as much again for each word in the heading;
    the rules multiply it into score, and adjustment is what they add to a cosine. A question without words gives no rows.
    """
    neighbours = F.array_except(F.coalesce("neighbours", F.expr("cast(array() as array<string>)")), "words")
    q = asked.where("size(words) > 0").select("question", "term", F.concat("words", neighbours).alias("asked"), F.size("words").alias("main"))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("section", F.lit("")), F.coalesce("text", F.lit("")), F.coalesce("keys", F.lit("")))
    rows = passages.join(q, "question").withColumn("own", tx.tokens(tx.normalize(text))).withColumn("head", tx.tokens(tx.normalize(F.coalesce("section", F.lit("")))))
    rows = rows.withColumn("f", F.transform("asked", lambda m: F.size(F.filter("own", lambda t: _fits(t, m))))).withColumn("len", F.size("own"))
    rows = rows.withColumn("heads", F.size(F.filter("asked", lambda m: F.exists("head", lambda t: _fits(t, m))))).withColumn("r", relation(F.col("title"), F.col("term")))
    by = Window.partitionBy("question")
    rows = rows.withColumn("N", F.count("*").over(by)).withColumn("mean", F.avg("len").over(by)).withColumn("general", F.max(F.col("r.kind").isin("exact", "begins")).over(by))

    each = rows.select("question", "passage", "main", "len", "N", "mean", F.posexplode("f").alias("j", "tf"))
    each = each.withColumn("df", F.count_if(F.col("tf") > 0).over(Window.partitionBy("question", "j")))
    weight = F.when(F.col("j") < F.col("main"), 1.0).otherwise(SECONDARY)
    idf = weight * F.ln(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    sums = each.groupBy("question", "passage").agg(F.sum(part).alias("bm25"))

    foreign = ~F.exists(F.col("r.extras"), lambda x: F.exists("asked", lambda m: _fits(x, m)))
    special = (F.col("r.kind") == "special") & F.col("general") & (F.size("r.extras") >= 2) & foreign
    kind = F.when(special, "special").when(F.col("r.kind").isin("exact", "begins"), F.col("r.kind"))
    usual = lx.general_section(F.col("section"))
    times, plus = F.lit(1.0), F.lit(0.0)
    for name, factor in FACTOR.items():
        holds = usual if name == "general" else F.coalesce(F.col("kind") == name, F.lit(False))
        times = times * F.when(holds, factor).otherwise(1.0)
        plus = plus + F.when(holds, ADDED.get(name, 0.0)).otherwise(0.0)
    out = rows.withColumn("kind", kind).join(sums, ["question", "passage"]).withColumn("raw", F.col("bm25") * (1 + IN_SECTION * F.col("heads")))
    out = out.select("question", "passage", (F.col("raw") * times).alias("score"), "raw", F.round(plus, 4).alias("adjustment")).where("score > 0")
    return cap(out, "question", n, F.desc(F.round("score", 9)), "passage")


def note() -> Column:
    return F.col("cosine") + F.coalesce("adjustment", F.lit(0.0))


def promoted(passages: DataFrame, strong: float) -> DataFrame:
    """passages (question, passage, title, cosine, adjustment, level, floor, ...) with the adjustment that a whole keyword gives.

    Of the complete ones at or above their floor the one of the highest cosine wins its question; the others of other titles, and
    the moderate ones, get up to 0.05, never across ``strong``. Then the winner is raised to ``strong`` or just above the best
    passage of another title, rounded up. A passage without a cosine stays as it is."""
    by = Window.partitionBy("question")
    able = F.col("cosine").isNotNull()
    complete = able & (F.col("level") == "complete") & (F.col("cosine") >= F.col("floor"))
    best = F.max(F.when(complete, F.struct(F.col("cosine").alias("c"), (-F.col("passage")).alias("p"), F.col("title").alias("t")))).over(by)
    rows = passages.withColumn("_best", best)
    won, mine = F.col("_best").isNotNull(), F.coalesce(F.col("passage") == -F.col("_best.p"), F.lit(False))
    alike = won & (F.col("title") == F.col("_best.t"))
    floor = F.when(F.col("level") == "complete", ALONE).otherwise(F.col("floor"))
    bonus = F.least(F.lit(BONUS), F.lit(strong) - 0.001 - note())
    helped = able & F.col("level").isNotNull() & ~F.coalesce(alike, F.lit(False)) & (F.col("cosine") >= floor) & (note() < strong) & (bonus > 0)
    rows = rows.withColumn("adjustment", F.when(helped, F.round(F.coalesce("adjustment", F.lit(0.0)) + bonus, 4)).otherwise(F.col("adjustment")))
    others = F.max(F.when(able & ~F.coalesce(alike, F.lit(False)), note())).over(by)
    rows = rows.withColumn("_goal", F.greatest(F.lit(strong), F.coalesce(others + 0.001, F.lit(-1.0))))
    raised = F.ceil((F.col("_goal") - F.col("cosine")) * 1e4 + 1) / 1e4
    return rows.withColumn("adjustment", F.when(mine & (note() < F.col("_goal")), raised).otherwise(F.col("adjustment"))).select(*passages.columns)


def merged(passages: DataFrame, n: int) -> DataFrame:
    """passages (question, passage, origin, word_rank, cosine, adjustment, coverage, ...) of all sources with ``rank``, n a question.

    Order: cosine and adjustment, where the question has any cosine; passages of other sources than ``documents`` need one then;
    else coverage. The documents' best keyword hit (word_rank 1) takes the last place if it is not among them."""
    by = Window.partitionBy("question")
    rows = passages.withColumn("_v", F.max(F.col("cosine").isNotNull()).over(by)).where((F.col("origin") == "documents") | ~F.col("_v") | F.col("cosine").isNotNull())
    value = F.when(F.col("_v"), F.coalesce("cosine", F.lit(-1.0)) + F.coalesce("adjustment", F.lit(0.0))).otherwise(F.coalesce("coverage", F.lit(0.0)))
    rows = rows.withColumn("rank", F.row_number().over(by.orderBy(value.desc(), F.col("passage"))))
    exact = (F.col("origin") == "documents") & (F.col("word_rank") == 1)
    rows = rows.withColumn("_late", F.max(F.when(exact, F.col("rank"))).over(by) > n)
    rows = rows.withColumn("rank", F.when(F.coalesce(F.col("_late") & exact, F.lit(False)), F.lit(n)).when(F.coalesce(F.col("_late"), F.lit(False)) & (F.col("rank") == n), F.lit(n + 1)).otherwise(F.col("rank")))
    return rows.where(F.col("rank") <= n).select(*passages.columns, "rank")


def for_model(passages: DataFrame, thresholds: DataFrame, emergency: str | None = None) -> DataFrame:
    """The passages (question, passage, origin, cosine, word_rank, guide, ...) worth reading by a model; thresholds (origin, answer, close).

    At or above ``close`` of their source, and: within 0.1 of the question's best, or the best keyword hit, or the best of a
    source above its ``answer``, or, where the column ``emergency`` is true, the best of a guide."""
    rows = passages.join(thresholds, "origin").where(F.col("cosine") >= F.col("close"))
    best = F.max("cosine").over(Window.partitionBy("question"))
    place = lambda *by: F.row_number().over(Window.partitionBy("question", *by).orderBy(F.desc("cosine"), "passage"))
    rows = rows.withColumn("_best", best).withColumn("_own", place("origin")).withColumn("_guide", F.when(F.col("guide"), place("guide")))
    keep = (F.col("cosine") >= F.col("_best") - GAP) | (F.col("word_rank") == 1) | ((F.col("_own") == 1) & (F.col("cosine") >= F.col("answer")))
    if emergency:
        keep = keep | (F.col(emergency) & (F.col("_guide") == 1))
    return rows.where(keep).select(*passages.columns)
