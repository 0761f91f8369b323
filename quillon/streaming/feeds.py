"""Stateful streams over events (event_id, ts timestamp, user_id, ...): rate limit, link state, upserts, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.tables import upsert
from quillon.session import ship


def rate_limited(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """(key, event_id, ts) of the events that come so long after the key's last accepted one; rejected ones do not move the clock.

    The state is one time per key. Within a batch a key's rows are taken in order of time."""

    def run(name, frames, state):
        import pandas as pd

        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        kept = []
        for event, ts in zip(rows["event_id"], rows["ts"], strict=True):
            now = ts.timestamp()
            if last is None or now - last >= seconds:
                last = now
                kept.append((name[0], event, ts))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=[key, "event_id", "ts"])

    ship(events.sparkSession)
    rows = events.select(key, "event_id", "ts")
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long, ts timestamp", "last double", "append", "NoTimeout")


def link_changes(events: DataFrame, key: str, state_of: str) -> DataFrame:
    """(key, event_id, ts, state) of the events at which a key's state changes, the first one included. state_of: SQL that gives it."""

    def run(name, frames, state):
        import pandas as pd

        now = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for event, ts, new in zip(rows["event_id"], rows["ts"], rows["state"], strict=True):
            if new != now:
                now = new
                out.append((name[0], event, ts, new))
        if now is not None:
            state.update((now,))
        yield pd.DataFrame(out, columns=[key, "event_id", "ts", "state"])

    ship(events.sparkSession)
    rows = events.select(key, "event_id", "ts", F.expr(state_of).alias("state"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long, ts timestamp, state string", "now string", "append", "NoTimeout")


def windowed(events: DataFrame, width: str, late: str) -> DataFrame:
    """(start, event_type, n): counts in tumbling windows; events later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def distinct(events: DataFrame, late: str) -> DataFrame:
    """Events without those that repeat an event_id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table that a versioned folder points at; None before the first version."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/pointer")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    last = spark.read.schema("version long").json(f"{folder}/pointer").agg(F.max("version")).first()[0]
    return None if last is None else spark.read.parquet(f"{folder}/v={last}")


def install(df: DataFrame, folder: str, version: int) -> None:
    """Write a version beside the others, then its pointer row: readers see the old one until the new one is whole. Repeating a version replaces it."""
    df.write.mode("overwrite").parquet(f"{folder}/v={version}")
    df.sparkSession.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{folder}/pointer")


def upserts(folder: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts each batch's rows, the last of each key, into a versioned table."""

    def run(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), F.struct("ts", "event_id")).alias("x")).select(key, "x.*")
        old = current(batch.sparkSession, folder)
        install(newest.select(*batch.columns) if old is None else upsert(old, newest.select(*old.columns), key), folder, batch_id)

    return run
