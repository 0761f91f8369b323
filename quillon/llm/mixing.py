"""Mixing sources to target weights by capped water-filling (operator 5).

Targets: each source gets its weight's share of the total size, at most ``cap`` times its own size; what is over a cap is
shared again by weight among the others until none is above. With sources in order of cap / weight that has a closed form over
running sums. A source's epochs are target / size: the whole part repeats every document, the rest takes one more copy of the
documents whose seeded hash is lowest. Where that lot ends is found from sums over 4096 ranges of the hash and then within one
range, so no source is ever gathered in one task; what a large document at the end leaves open is filled with smaller ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, stage

RANGES = 12  # bits


def sized(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs with _size (words of the text, null: 0) and _u, a seeded hash in 63 bits."""
    size = F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE), "")).cast("long")
    return docs.withColumn("_size", size).withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("_size")), 1))


def targets(totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row a source, so the running sums are over few rows."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    df = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank - 1) % len(weights) + 1))
    df = df.withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # the level if all sources before this one are clamped and this one is not; it falls from the first where that holds
    df = df.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    df = df.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))).over(whole))
    return df.select("source", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("w"))).alias("target"))


def cut(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """(_source, got, cut): the highest _u so that the rows of a source up to it hold at most ``rest`` words, and how many they hold."""
    piece = F.shiftright("_u", 63 - RANGES)
    sums = sizes.groupBy("source", piece.alias("b")).agg(F.sum("_size").alias("s"))
    rising = Window.partitionBy("source").orderBy("b")
    own = goal.select(F.col("source").alias("_source"), "rest")
    at = sums.withColumn("before", F.sum("s").over(rising) - F.col("s")).join(own, F.col("source").eqNullSafe(F.col("_source")))
    # the first range that overflows; a source without one is taken whole
    at = at.groupBy("_source", "rest").agg(F.min(F.when(F.col("before") + F.col("s") > F.col("rest"), F.struct("b", "before"))).alias("x"), F.sum("s").alias("all"))
    at = stage(at.select("_source", "rest", "x.b", "x.before", "all"), "ranges")
    last = sizes.join(at.where("b is not null"), sizes["source"].eqNullSafe(at["_source"]) & (piece == at["b"])).groupBy("_source", "before", "rest", "_u").agg(F.sum("_size").alias("s"))
    last = last.withColumn("upto", F.col("before") + F.sum("s").over(Window.partitionBy("_source").orderBy("_u"))).where("upto <= rest")
    last = last.groupBy(F.col("_source").alias("_last")).agg(F.max("_u").alias("u"), F.max("upto").alias("upto"))
    below = F.shiftleft(F.col("b").cast("long"), 63 - RANGES) - 1
    found = at.join(last, at["_source"].eqNullSafe(last["_last"]), "left")
    return found.select("_source", F.when(F.col("b").isNull(), F.col("all")).otherwise(F.coalesce("upto", "before")).alias("got"), F.when(F.col("b").isNull(), F.lit((1 << 63) - 1)).otherwise(F.coalesce("u", below)).alias("cut"))


def rates(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, rounds: int = 3) -> DataFrame:
    """(source, source_size, target, whole, steps): documents get ``whole`` copies, and one more if a step holds for them.

    The first step takes the documents of lowest hash while they fit. What is missing then is less than one document; the next
    steps go on with the documents that are small enough for it."""
    totals = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
    goal = targets(totals, weights, cap).withColumn("whole", F.coalesce(F.floor(F.expr("try_divide(target, source_size)") + 1e-9), F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    goal = stage(goal.withColumn("steps", F.expr("cast(array() as array<struct<above:bigint,cut:bigint,most:double>>)")), "goals")
    for k in range(rounds):
        left = sizes
        if k:
            own = goal.select(F.col("source").alias("_source"), F.col("rest").alias("_rest"), F.col("steps")[k - 1]["cut"].alias("_above"))
            left = sizes.join(own, sizes["source"].eqNullSafe(own["_source"])).where("_u > _above and _size <= _rest and _size > 0").select("source", "_size", "_u")
        found = cut(left, goal)
        above = F.lit(-1).cast("long") if not k else F.col("steps")[k - 1]["cut"]
        step = F.struct(above.alias("above"), F.coalesce("cut", above).alias("cut"), (F.lit(1e300) if not k else F.col("rest")).alias("most"))
        goal = goal.join(found, goal["source"].eqNullSafe(found["_source"]), "left").select("source", "source_size", "target", "whole", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("rest"), F.concat("steps", F.array(step)).alias("steps"))
        goal = stage(goal, "goals")
    return goal.drop("rest")


def apply(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of sized() with source_size, target and copies, from rates() with source renamed _source."""
    rows = rows.join(found, rows["source"].eqNullSafe(found["_source"]), "left").drop("_source")
    more = F.exists("steps", lambda x: (F.col("_u") > x["above"]) & (F.col("_u") <= x["cut"]) & (F.col("_size") <= x["most"])).cast("long")
    return rows.withColumn("copies", F.when(F.col("target") > 0, F.col("whole") + more).otherwise(F.lit(0))).drop("whole", "steps", "_u")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """Every row of docs with _size, source_size, target, copies.

    Null texts have size 0; a null source is a source of its own, last in order; rows that repeat a doc_id and size are taken
    together; a source without words has target 0 and copies 0. An empty table gives an empty result. Reruns agree. Columns of docs
    with the names of the new ones are replaced; mixed() leaves all as they are.
    """
    rows = sized(docs.drop("_size", "_u", "source_size", "target", "copies"), seed)
    found = stage(rates(stage(rows.select("source", "_size", "_u"), "sizes"), weights, cap), "rates").withColumnRenamed("source", "_source")
    return apply(rows, found)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "source")
    return mix(rows, **how).where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
