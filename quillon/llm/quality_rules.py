"""Quality rules with risk-controlled thresholds (operator 4). Native: DataFrame functions only.

Each rule rejects a document whose rate (symbols per word, repeated lines, repeated words, capitals, long or short words) is
over a cutoff. Cutoffs are chosen per stratum (here: lang) from labelled rows. One half of the clean labelled rows proposes
levels: at a level every rule's cutoff is the same quantile of its rate, so a stricter level rejects all that a looser one does. The
other half, the holdout, tests each level's joint verdict: under the hypothesis that its rules together reject more than alpha of the
clean documents, the chance of as few rejections as seen is an exact binomial tail, and a level is valid if that is at most
delta / strata (Bonferroni over strata). Levels are tested from the loosest on and the first that is not valid ends the test (fixed sequence, so
their number costs nothing); the strictest one before it is taken, none if there is none. So with probability 1 - delta no stratum
loses more than alpha of its clean documents to the rules. With four strata and the defaults a stratum needs 217 held-out rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, stage

#: name: rate of a document, as SQL over the measures. A rule rejects what is over its cutoff.
RULES = {
    "symbol_rate": "n_symbols / n_words",
    "dup_line_rate": "n_dup_lines / n_lines",
    "repeat_rate": "n_repeat_words / n_words",
    "upper_rate": "n_upper / word_chars",
    "long_words": "word_chars / n_words",
    "short_words": "-word_chars / n_words",
}
QUANTILES = (0.9, 0.95, 0.975, 0.99, 0.995, 0.998, 0.999, 0.9995, 1.0)


def measure(docs: DataFrame) -> DataFrame:
    """docs with the measures n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, base_failed.

    All work is within a row, so nothing is shuffled. Repeated three-word windows are found by sorting, per document, numbers
    that hold a window's hash above its position; full 64-bit hashes then confirm what the shortened ones find. A null text is
    an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("_w", F.array_remove(F.split(text, SPACE), ""))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_upper": F.regexp_count(text, F.lit("\\p{Lu}")).cast("long"),
    })
    df = df.withColumn("_h", F.expr("if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))"))
    df = df.withColumn("_m", F.expr("shiftleft(1L, cast(ceil(log2(n_words + 2)) as int)) - 1"))
    df = df.withColumn("_s", F.expr("sort_array(transform(_h, (h, i) -> (h & ~_m) | i))"))
    same = "((_s[{0}] & ~_m) = (_s[{1}] & ~_m) and _h[cast(_s[{0}] & _m as int)] = _h[cast(_s[{1}] & _m as int)])"
    df = df.withColumn("_p", F.expr(f"sort_array(transform(filter(sequence(0, greatest(size(_s) - 1, 0)), i -> size(_s) > 1 and ((i > 0 and {same.format('i', 'greatest(i - 1, 0)')}) or (i < size(_s) - 1 and {same.format('i', 'least(i + 1, size(_s) - 1)')}))), i -> cast(_s[i] & _m as int)))"))
    df = df.withColumn("n_repeat_words", F.expr("aggregate(sequence(0, greatest(size(_p) - 1, 0)), 0L, (a, i) -> a + if(size(_p) = 0, 0, if(i = size(_p) - 1, 3, least(3, _p[least(i + 1, size(_p) - 1)] - _p[i]))))"))
    return df.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).drop("_w", "_lines", "_h", "_m", "_s", "_p")


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, cut_<rule> double): the cutoffs of the strictest valid level of each stratum that has one."""
    clean = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1")
    rates = [F.expr(f"try_divide({sql.split(' / ')[0]}, {sql.split(' / ')[1]})").alias(name) for name, sql in RULES.items()]
    rows = measured.where("not base_failed").select("doc_id", F.col(stratum).alias("stratum"), *rates).join(clean, "doc_id")
    rows = stage(rows.select("stratum", (F.crc32(F.col("doc_id").cast("string")) % 2).alias("half"), *RULES), "labelled")
    grid = rows.where("half = 0").groupBy("stratum").agg(*[F.percentile_approx(r, list(QUANTILES), 10000).alias(f"g_{r}") for r in RULES])
    held = rows.where("half = 1").join(grid, rows["stratum"].eqNullSafe(grid["stratum"])).drop(grid["stratum"])
    rejected = lambda i: " or ".join(f"coalesce({r} > g_{r}[{i}], false)" for r in RULES)
    counts = F.array(*[F.count_if(F.expr(rejected(i))) for i in range(len(QUANTILES))])
    held = held.groupBy("stratum").agg(F.count("*").alias("n"), counts.alias("ks"), *[F.first(f"g_{r}").alias(f"g_{r}") for r in RULES])
    each = held.select("stratum", "n", F.posexplode("ks").alias("level", "k"), *[f"g_{r}" for r in RULES])
    miss, odds = f"ln(1 - {alpha!r}D)", f"ln({alpha!r}D / (1 - {alpha!r}D))"
    tail = F.expr(f"""aggregate(if(k = 0, cast(array() as array<bigint>), sequence(1L, k)), named_struct('t', n * {miss}, 's', exp(n * {miss})),
        (a, i) -> named_struct('t', a.t + ln((n - i + 1) / i) + {odds}, 's', a.s + exp(a.t + ln((n - i + 1) / i) + {odds})), a -> a.s)""")
    strata = held.agg(F.count("*").alias("strata"))
    # fewer are rejected at looser levels, so the valid levels are the loosest ones and the sequence ends at the strictest of them
    valid = each.where(F.col("k") <= F.col("n") * alpha).crossJoin(F.broadcast(strata)).where(tail <= delta / F.col("strata"))
    return valid.groupBy("stratum").agg(*[F.min_by(F.col(f"g_{r}")[F.col("level")], "level").alias(f"cut_{r}") for r in RULES])


def judge(measured: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured with kept: neither base_failed nor over a cutoff of its stratum."""
    cuts = cuts.withColumnRenamed("stratum", "_stratum")
    over = F.lit(False)
    for name, sql in RULES.items():
        top, bottom = sql.split(" / ")
        over = over | F.coalesce(F.expr(f"try_divide({top}, {bottom}) > cut_{name}"), F.lit(False))
    df = measured.join(cuts, measured[stratum].eqNullSafe(cuts["_stratum"]), "left").withColumn("kept", ~F.col("base_failed") & ~over)
    return df.drop("_stratum", *[f"cut_{r}" for r in RULES])


def quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Every row of docs with its measures and kept. A repeated row is judged each time; a stratum without enough labelled rows
    has no cutoffs, so only base_failed rejects there; labels that repeat a document count by their lowest quality; null labels
    count as none; an empty table gives an empty result. Columns of docs with the measures' names are replaced."""
    mine = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "base_failed", "kept"]
    measured = stage(measure(docs.drop(*mine)), "measured")
    return judge(measured, stage(cutoffs(measured, labels, stratum, alpha, delta), "cutoffs"), stratum)


def accepted(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **how) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", stratum)
    measured = stage(measure(rows).drop("text"), "measured")
    return judge(measured, stage(cutoffs(measured, labels, stratum, **how), "cutoffs"), stratum).where("kept").select("_row.*")
