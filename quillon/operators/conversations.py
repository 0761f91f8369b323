"""Conversations and their messages in a store of tables that change together: exchanges, new titles, deletions, in batches.

The store is a log: a batch adds rows to both tables under one manifest, a deletion is a row too, so nothing is rewritten before
compact(). An exchange is written once its answer is there. Titles come from the first question, without a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.snapshots import Snapshot, Store
from quillon.session import kept

# Letters of a title made from a question and of one that is given, the title of an empty question, how many are listed.
FROM_QUESTION, GIVEN, UNTITLED, LISTED = 50, 100, "Sans titre", 200


def one_line(text: Column, most: int) -> Column:
    """Text with single blanks and at most ``most`` characters; null for none."""
    return F.nullif(F.left(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")), F.lit(most)), F.lit(""))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``number`` from 0 in a total order: sorted in ranges, counted by range, so no task has them all. Written before it is read twice."""
    parts = kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("number", place).join(F.broadcast(before), "_part").withColumn("number", F.col("number") + F.col("_before")).drop("_part", "_before")


def _threads(snapshot: Snapshot) -> DataFrame | None:
    """(id, title, created, changed, deleted): the newest state of each conversation there ever was."""
    if "threads" not in snapshot:
        return None
    newest = F.max_by("title", F.when(F.col("title").isNotNull(), F.struct("version", "changed")))
    return snapshot.table("threads").groupBy("id").agg(newest.alias("title"), F.min("created").alias("created"), F.max("changed").alias("changed"), F.max("deleted").alias("deleted"))


def conversations(snapshot: Snapshot, most: int = LISTED) -> DataFrame:
    """(id, title, created, changed) of the conversations that are there, the last changed first, at most ``most``."""
    return present(snapshot).orderBy(F.desc("changed"), F.desc("id")).limit(most)


def present(snapshot: Snapshot) -> DataFrame:
    """All conversations that are not deleted; the store must have had an exchange."""
    return _threads(snapshot).where("not deleted").drop("deleted")


def messages(snapshot: Snapshot) -> DataFrame:
    """(conversation, at, kind, text, sources, outcome) of the conversations that are there; by (conversation, at, kind desc) in order."""
    return snapshot.table("messages").join(present(snapshot).select(F.col("id").alias("conversation")), "conversation", "left_semi").drop("version")


def add(store: Store, exchanges: DataFrame) -> DataFrame:
    """Write finished exchanges, both tables at once; returns (request, conversation).

    exchanges (request, conversation, question, answer, sources array<string>, outcome int, asked, answered): request is unique. One whose
    answer is null is not finished and is left out. A null or unknown conversation, a deleted one too, makes a new one of its
    own; numbers go up by (asked, request) and are never used again."""
    with store.change() as change:
        base = change.base
        known = _threads(base)
        done = exchanges.where("answer is not null")
        if known is None:
            done = done.withColumn("_id", F.lit(None).cast("long"))
        else:
            alive = known.where("not deleted").select(F.col("id").alias("_id"))
            done = done.join(alive, F.col("conversation").cast("long") == F.col("_id"), "left")
        done = kept(done, "exchanges")
        first = base.notes.get("next", 1)
        fresh = numbered(done.where("_id is null").select("asked", "request"), "asked", "request")
        rows = kept(done.join(fresh.select("request", (F.col("number") + first).alias("_new")), "request", "left").withColumn("id", F.coalesce("_id", "_new")), "exchanges")
        title = F.when(F.col("_new").isNotNull(), F.coalesce(one_line(F.col("question"), FROM_QUESTION), F.lit(UNTITLED)))
        version = F.lit(change.version).cast("long")
        change.append("threads", rows.select("id", title.alias("title"), F.when(F.col("_new").isNotNull(), F.col("asked")).alias("created"), F.col("asked").alias("changed"), F.lit(False).alias("deleted"), version.alias("version")))
        none = F.lit(None)
        asked = rows.select(F.col("id").alias("conversation"), F.col("asked").alias("at"), F.lit("question").alias("kind"), F.col("question").alias("text"), none.cast("array<string>").alias("sources"), none.cast("int").alias("outcome"), version.alias("version"))
        told = rows.select(F.col("id").alias("conversation"), F.col("answered").alias("at"), F.lit("answer").alias("kind"), F.col("answer").alias("text"), F.coalesce("sources", F.expr("cast(array() as array<string>)")).alias("sources"), F.col("outcome").cast("int").alias("outcome"), version.alias("version"))
        change.append("messages", asked.unionByName(told))
        change.notes["next"] = first + fresh.count()
    return rows.select("request", F.col("id").alias("conversation"))


def rename(store: Store, titles: DataFrame) -> DataFrame:
    """Give conversations (id, title) new titles; unknown ones stay unknown. Returns the rows refused for an empty title."""
    known = present(store.snapshot()).select("id")
    told = titles.withColumn("title", one_line(F.col("title"), GIVEN))
    rows = told.where("title is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.max("title").alias("title")).join(known, "id", "left_semi")
    none = F.lit(None).cast(store.snapshot().table("threads").schema["changed"].dataType)
    with store.change() as change:
        change.append("threads", rows.select("id", "title", none.alias("created"), none.alias("changed"), F.lit(False).alias("deleted"), F.lit(change.version).cast("long").alias("version")))
    return titles.where(one_line(F.col("title"), GIVEN).isNull())


def delete(store: Store, ids: DataFrame) -> None:
    """Delete conversations (id) with their messages; unknown ids are nothing."""
    state = store.snapshot()
    rows = present(state).join(ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
    none = F.lit(None)
    kind = state.table("threads").schema["changed"].dataType
    with store.change() as change:
        change.append("threads", rows.select("id", none.cast("string").alias("title"), none.cast(kind).alias("created"), none.cast(kind).alias("changed"), F.lit(True).alias("deleted"), F.lit(change.version).cast("long").alias("version")))


def clear(store: Store) -> None:
    """Delete all conversations and messages in one change; their numbers are not used again."""
    state = store.snapshot()
    with store.change() as change:
        for name in ("threads", "messages"):
            if name in state:
                change.put(name, state.table(name).limit(0))


def compact(store: Store) -> None:
    """Write both tables anew without what is deleted, one row for each conversation."""
    state = store.snapshot()
    version = F.lit(state.version).cast("long").alias("version")
    with store.change() as change:
        change.put("threads", present(state).select("id", "title", "created", "changed", F.lit(False).alias("deleted"), version))
        change.put("messages", messages(state).withColumn("version", F.lit(state.version).cast("long")))
