"""Table maintenance and event logic: differences, merges, retention, islands, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, state): new, modified, deleted or same, from a full outer join on key and a comparison of ``mark``."""
    a, b = old.select(key, F.col(mark).alias("_a")), new.select(key, F.col(mark).alias("_b"))
    there = lambda c: F.col(c).isNotNull()
    state = F.when(~there("_a"), "new").when(~there("_b"), "deleted").when(F.col("_a") != F.col("_b"), "modified").otherwise("same")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def dealt(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """df dealt by key over ``tasks`` where the session's shuffles would have fewer, so that a join's task grows no larger with the tables."""
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def replace_children(old: DataFrame, new: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """old without the rows of the parents in touched, and all rows of new: changed parents are replaced whole, deleted ones go.

    The join has eight tasks for each of old's at least."""
    tasks = 8 * old.rdd.getNumPartitions()
    return dealt(old, key, tasks).join(dealt(touched.select(key), key, tasks).distinct(), key, "left_anti").unionByName(new)


def positions(rows: DataFrame, *order) -> DataFrame:
    """rows with their position in order; for tables of a few rows, such as sums by group: all rows meet in one task."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in or replaced by key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def retain(events: DataFrame, days: int, newest: int) -> DataFrame:
    """Rows not older than ``days`` before the last one, of those the newest ones (ties: the higher event_id)."""
    last = events.agg(F.max("ts").alias("_last"))  # one row
    young = events.crossJoin(F.broadcast(last)).where(F.expr(f"ts >= _last - interval {days} days")).drop("_last")
    return young.orderBy(F.desc("ts"), F.desc("event_id")).limit(newest)


def feed(events: DataFrame, since: int, generation: int, known: int) -> DataFrame:
    """What a reader lacks: rows after ``since`` if it knows this generation, else all rows."""
    return events.where(F.col("event_id") > since) if generation == known else events


def changes(present: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, action) for tables with size and hash: new, deleted, changed, same_hash (another size, yet the same content) or keep."""
    a, b = present.select(key, F.col("size").alias("_s"), F.col("hash").alias("_h")), known.select(key, F.col("size").alias("_t"), F.col("hash").alias("_g"))
    action = F.when(F.col("_t").isNull(), "new").when(F.col("_s").isNull(), "deleted").when(F.col("_s") == F.col("_t"), "keep").when(F.col("_h") == F.col("_g"), "same_hash").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def merged(intervals: DataFrame, key: str) -> DataFrame:
    """(key, start, end, n): overlapping and touching intervals of a key put together."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def overlaps(nets: DataFrame, masks: list[int]) -> DataFrame:
    """(a, b) of networks (id, base, bits) that overlap: equal on the shorter mask. Joined on that prefix, not pair by pair."""
    shorter = nets.select(F.col("id").alias("a"), F.col("bits").alias("m"), F.expr("shiftright(base, 32 - bits)").alias("prefix"))
    each = nets.withColumn("m", F.explode(F.array(*[F.lit(x) for x in masks]))).where("m <= bits")
    longer = each.select(F.col("id").alias("b"), "bits", "m", F.expr("shiftright(base, 32 - m)").alias("prefix"))
    found = shorter.join(longer, ["m", "prefix"]).where("a <> b and (bits > m or a < b)")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def variants(packs: DataFrame, entries: DataFrame) -> DataFrame:
    """packs (name, variant, ...) with ``entry``, the first entry (name, variant, entry) of the name with the same variant or ``-``."""
    first = entries.groupBy("name", "variant").agg(F.min("entry").alias("entry"))
    anyone = first.where("variant = '-'").select("name", F.col("entry").alias("_any"))
    found = packs.join(first, ["name", "variant"], "left").join(anyone, "name", "left")
    return found.withColumn("entry", F.least("entry", "_any")).drop("_any")


def islands(events: DataFrame, key: str, state: Column) -> DataFrame:
    """(key, state, first, last, first_id, n): stretches of events in the same state, by time."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    marked = events.withColumn("state", state).withColumn("turn", F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("turn").over(w))
    return numbered.groupBy(key, "island", "state").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.min("event_id").alias("first_id"), F.count("*").alias("n"))


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """(key, first, last, n): events closer than ``gap`` belong together."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("s")


def leases(releases: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, since, until, n): stretches in which a key is released, each release (key, ts) lasting ``seconds`` from its time.

    A release at the very end of a stretch begins a new one. Stretches are found within a day first, at most one more than fit in it, and then
    joined over days: no key is sorted whole. A null key is a key; rows without a time are left out."""
    ts = F.col("ts").cast("timestamp")
    rows = releases.where("ts is not null").select(key, ts.alias("first"), ts.alias("last"), F.lit(1).cast("long").alias("n"), F.to_date(ts).alias("day"))
    for parts in ([key, "day"], [key]):
        w = Window.partitionBy(*parts).orderBy("first", "last")
        new = F.coalesce(F.unix_micros("first") >= F.unix_micros(F.lag("last").over(w)) + F.lit(seconds * 1_000_000), F.lit(True))
        numbered = rows.withColumn("stretch", F.sum(new.cast("int")).over(w))
        rows = numbered.groupBy(*parts, "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("stretch")
    return rows.select(key, F.col("first").alias("since"), F.timestamp_micros(F.unix_micros("last") + F.lit(seconds * 1_000_000)).alias("until"), "n")


def accepted(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, event_id) that a rate limit lets through: at least so long after the last accepted one of the key.

    An event so long after the one before it is accepted whatever came earlier, so a fold need only see one burst: a key's events
    are cut there, and no key is gathered whole."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    free = F.expr(f"coalesce(ts >= _before + interval {seconds} seconds, true)")
    cut = events.withColumn("_before", F.lag("ts").over(w)).withColumn("_burst", F.sum(free.cast("int")).over(w))
    folded = cut.groupBy(key, "_burst").agg(F.sort_array(F.collect_list(F.struct(F.col("ts").alias("t"), "event_id"))).alias("x"))
    start = "named_struct('last', cast(null as timestamp_ntz), 'ok', cast(array() as array<bigint>))"
    step = f"if(a.last is null or e.t >= a.last + interval {seconds} seconds, named_struct('last', e.t, 'ok', array_append(a.ok, e.event_id)), a)"
    return folded.select(key, F.explode(F.expr(f"aggregate(x, {start}, (a, e) -> {step}, a -> a.ok)")).alias("event_id"))


def in_network(ip: Column, cidr: str) -> Column:
    """Whether a dotted IPv4 address is in a network, which without a length is one address; null for what is no address."""
    base, _, bits = cidr.partition("/")
    bits = bits or "32"
    net = sum(int(x) << (24 - 8 * k) for k, x in enumerate(base.split("."))) >> (32 - int(bits))
    parts = F.split(ip, "[.]")
    number = sum((F.shiftleft(parts[k].cast("long"), 24 - 8 * k) for k in range(1, 4)), F.shiftleft(parts[0].cast("long"), 24))
    return F.when(ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?:\.(?!$)|$)){4}$"), F.shiftright(number, 32 - int(bits)) == net)


def first_rule(rows: DataFrame, rules: DataFrame, fields: list[str]) -> DataFrame:
    """rows with ``answer`` of the first rule, by ordinal, all of whose patterns fit; ``*`` stands for anything. No rule: null.

    The rules are a configuration table of a few rows, read into one expression, so the rows are not shuffled. More than 1000: ValueError."""
    listed = rules.limit(1001).collect()
    if len(listed) > 1000:
        raise ValueError("more than 1000 rules")
    answer = F.lit(None)
    for rule in sorted(listed, key=lambda r: -r["ordinal"]):
        fits = F.lit(True)
        for name in fields:
            pattern = "(?s)^" + ".*".join("\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E" for x in rule[name].split("*")) + "$"
            fits = fits & F.col(f"_{name}").rlike(pattern)
        answer = F.when(fits, F.lit(rule["answer"])).otherwise(answer)
    return rows.withColumn("answer", answer)
