"""Streams over a file source against their batch forms."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillon.operators import tables as tb
from quillon.streaming import feeds


@pytest.fixture
def stream(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for k, (low, high) in enumerate(((0, 300), (300, 600), (600, 10**9))):  # in order, one file a batch
        ev.where((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    return lambda: spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def finish(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_rate_limit(spark, sf, stream, tmp_path):
    got = {r["event_id"] for r in finish(feeds.rate_limited(stream(), "user_id", 6 * 3600), tmp_path, "limited").collect()}
    assert got == {r["event_id"] for r in tb.accepted(spark.read.parquet(f"{sf}/events.parquet"), "user_id", 6 * 3600).collect()}


def test_link_changes(spark, sf, stream, tmp_path):
    got = {r["event_id"] for r in finish(feeds.link_changes(stream(), "user_id", "if(event_type = 'error', 'down', 'up')"), tmp_path, "links").collect()}
    islands = tb.islands(spark.read.parquet(f"{sf}/events.parquet"), "user_id", F.when(F.col("event_type") == "error", "down").otherwise("up"))
    assert got == {r["first_id"] for r in islands.collect()}


def test_windows_and_distinct(spark, sf, stream, tmp_path):
    found = finish(feeds.windowed(stream(), "1 day", "1 hour"), tmp_path, "days", "complete")
    assert found.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
    assert finish(feeds.distinct(stream().unionByName(stream()), "40 days"), tmp_path, "once").count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_upserts(spark, sf, stream, tmp_path):
    q = stream().writeStream.foreachBatch(feeds.upserts(f"{tmp_path}/table", "user_id")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = {(r["user_id"], r["event_id"]) for r in feeds.current(spark, f"{tmp_path}/table").collect()}
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    assert got == {(r["user_id"], r["event_id"]) for r in want.collect()}
