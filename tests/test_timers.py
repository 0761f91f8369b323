"""Streams with timers against their table forms and plain rules: order of arrival, ends of leases, restarts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.operators import tables as tb
from quillon.streaming import timers

DAY = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
HOUR = dt.timedelta(hours=1)


def feed(spark, tmp_path, batches):
    """A stream with one batch for each list of (key, hours, event_id, value); returns (open, add)."""
    schema = "user_id long, ts timestamp, event_id long, value string"
    folder = f"{tmp_path}/in"

    def add(rows):
        made = [(k, DAY + h * HOUR, e, v) for k, h, e, v in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(folder)

    for rows in batches:
        add(rows)
    return (lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)), add


def finish(spark, df, tmp_path, name):
    """Runs all that is there, into a table of files that goes on over restarts."""
    writer = df.writeStream.format("parquet").option("path", f"{tmp_path}/out-{name}").option("checkpointLocation", f"{tmp_path}/ck-{name}").trigger(availableNow=True)
    assert timers.started(writer, spark).awaitTermination(150)
    return spark.read.parquet(f"{tmp_path}/out-{name}")


def rows_of(df, *columns):
    hours = lambda x: None if x is None else (x.astimezone(dt.UTC) - DAY) / HOUR if x.tzinfo else (x - DAY.replace(tzinfo=None)) / HOUR
    return sorted((tuple(hours(r[c]) if isinstance(r[c], dt.datetime) else r[c] for c in columns) for r in df.collect()), key=str)


def test_leases_end_by_timer_and_over_a_restart(spark, tmp_path):
    # the third row comes late, within the watermark; key 2 renews at the very end of its lease
    read, add = feed(spark, tmp_path, [[(1, 0, 1, None), (2, 0, 2, None), (None, 1, 9, None)], [(1, 15, 3, None)], [(1, 11, 4, None), (2, 12, 5, None)]])
    columns = ("user_id", "state", "ts", "since", "n")
    before = rows_of(finish(spark, timers.leases(read(), "user_id", "event_id", "5 hours"), tmp_path, "l"), *columns)
    assert (1, "begun", 0.0, 0.0, 1) in before and not [r for r in before if r[1] == "ended" and r[0] == 1]
    add([(3, 100, 6, None)])  # nothing of keys 1 and 2: their ends come from timers alone, with state of before the restart
    after = finish(spark, timers.leases(read(), "user_id", "event_id", "5 hours"), tmp_path, "l")
    assert rows_of(after.where("state = 'ended'"), *columns) == sorted([(1, "ended", 27.0, 0.0, 3), (2, "ended", 12.0, 0.0, 1), (2, "ended", 24.0, 12.0, 1), (None, "ended", 13.0, 1.0, 1)], key=str)
    assert after.where("state = 'begun' and user_id = 2").count() == 2


def test_leases_stream_equals_table(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.lit(None).cast("string").alias("value"))
    far = spark.createDataFrame([(-1, DAY + 10000 * HOUR, -1, None)], ev.schema)
    for k, part in enumerate((ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1"), far)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    read = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = finish(spark, timers.leases(read, "user_id", "event_id", "40 days"), tmp_path, "t").where("state = 'ended' and user_id >= 0")
    want = tb.leases(ev, "user_id", timers.LEASE)
    assert rows_of(got, "user_id", "since", "ts", "n") == rows_of(want, "user_id", "since", "until", "n")


def plain_log(probes, sparing):
    out, state, contact, written, at = [], None, None, None, None
    for hours, value in sorted(probes):
        value = value or "unknown"
        contact = hours if value == "up" else contact
        write = value != "silent" and contact != written and (value != "up" or at is None or hours - at > sparing)
        if write:
            written, at = contact, hours
        if value != state or write:
            out.append((hours, value, contact, write))
        state = value
    return out


PROBES = {
    1: [(0.0, "up"), (0.5, "up"), (1.0, "up"), (1.5, "up"), (2.5, "down"), (3.0, "down"), (3.5, "degraded"), (4.0, "up")],
    2: [(0.0, "down"), (1.0, None), (2.0, "silent"), (3.0, "up"), (3.5, "up"), (3.6, "silent"), (5.0, "silent"), (5.5, "up")],
    3: [(7.0, "silent")],
}


@pytest.mark.parametrize("form", ["stream", "table"])
def test_link_log(spark, tmp_path, form):
    rows = [(k, h, i, v) for k, p in PROBES.items() for i, (h, v) in enumerate(p)]
    columns = ("user_id", "ts", "state", "contact", "written")
    if form == "stream":
        read, _ = feed(spark, tmp_path, [rows[1::2], rows[::2], [(9, 1000, 0, "up")]])
        found = finish(spark, timers.link_log(read(), "user_id", "event_id", F.col("value"), "20 hours", 3600), tmp_path, "k").where("user_id < 9")
    else:
        df = spark.createDataFrame([(k, DAY + h * HOUR, i, v) for k, h, i, v in rows], "user_id long, ts timestamp, event_id long, value string")
        found = timers.link_log_of(df, "user_id", "event_id", F.col("value"), 3600)
        assert timers.link_log_of(df.limit(0), "user_id", "event_id", F.col("value")).count() == 0
    assert rows_of(found, *columns) == sorted(((k, *x) for k, p in PROBES.items() for x in plain_log(p, 1.0)), key=str)


def test_the_sessions_own_store_is_put_back(spark, tmp_path):
    before = spark.conf.get(timers.STORE)
    with pytest.raises(AttributeError):
        timers.started(None, spark)
    assert spark.conf.get(timers.STORE) == before
