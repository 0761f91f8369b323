"""Keyed state with event-time timers: leases that end by themselves, link states that are written down sparingly.

Rows wait in a key's state until the watermark has passed them and are then applied in order of time (``order`` breaks ties), so rows
that come out of order within the watermark change nothing. A key has one timer, at its next waiting row or at its next deadline.
A time to live of Spark's own would count by the clock of the machine, so that a restart after a stop would end leases at
other times; timers by event time do not. transformWithState needs the RocksDB state store: start such streams with started().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillon.session import ship

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds that a release lasts; seconds between two writes of the last contact while the link holds.
LEASE, SPARING = 12 * 3600, 600
US = 1_000_000


class Lease:
    """From its first release until ``length`` microseconds after its last one; the end itself is outside."""

    def __init__(self, kept: tuple | None, length: int):
        self.since, self.until, self.n = kept or (None, None, 0)
        self.length = length

    def kept(self) -> tuple | None:
        return None if self.until is None else (self.since, self.until, self.n)

    def deadline(self) -> int | None:
        return self.until

    def pass_to(self, now: int) -> list[tuple]:
        """What ends up to a time: (at, state, since, releases)."""
        if self.until is None or self.until > now:
            return []
        out = [(self.until, "ended", self.since, self.n)]
        self.since, self.until, self.n = None, None, 0
        return out

    def take(self, at: int, _value: str | None) -> list[tuple]:
        out = self.pass_to(at)
        if self.since is None:
            self.since = at
            out.append((at, "begun", at, 1))
        self.until, self.n = at + self.length, self.n + 1
        return out


class Link:
    """The state of a link, its last contact, and when that was last written."""

    def __init__(self, kept: tuple | None, sparing: int):
        self.state, self.contact, self.written, self.written_at = kept or (None, None, None, None)
        self.sparing = sparing

    def kept(self) -> tuple | None:
        return (self.state, self.contact, self.written, self.written_at)

    def deadline(self) -> int | None:
        return None

    def pass_to(self, _now: int) -> list[tuple]:
        return []

    def take(self, at: int, state: str | None) -> list[tuple]:
        """(at, state, last contact, 1 if it is written now): where the state changes or the contact is written."""
        state = state or "unknown"
        changed, self.state = state != self.state, state
        if state == "up":
            self.contact = at
        write = state != "silent" and self.contact != self.written and (state != "up" or self.written_at is None or at - self.written_at > self.sparing)
        if write:
            self.written, self.written_at = self.contact, at
        return [(at, state, self.contact, int(write))] if changed or write else []


class InOrder(StatefulProcessor):
    """Applies machine (Lease, Link or the like) to a key's rows (us, order, value) in order of time."""

    def __init__(self, machine: Callable, stored: str, key: str):
        self.machine, self.stored, self.key = machine, stored, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", self.stored)
        self.waiting = handle.getListState("waiting", "us long, place long, value string")

    def _wake(self, us: int, expired: int = -1) -> None:
        """One timer a key: the earliest. A row is due when the watermark, in milliseconds, is at its time or later. An expired timer is listed until its call ends."""
        wanted = us // 1000 + 1
        for there in [x for x in self.handle.listTimers() if x != expired]:
            if there <= wanted:
                return
            self.handle.deleteTimer(there)
        self.handle.registerTimer(wanted)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        first = None
        for frame in rows:
            if len(frame):
                self.waiting.appendList([(int(us), int(place), value) for us, place, value in zip(frame["us"], frame["place"], frame["value"], strict=True)])
                first = min(int(frame["us"].min()), first if first is not None else int(frame["us"].min()))
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        until = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for row in self.waiting.get() if self.waiting.exists() else ():
            (due if row[0] <= until else later).append(tuple(row))
        due.sort(key=lambda r: (r[0], r[1], r[2] or ""))
        machine = self.machine(tuple(self.now.get()) if self.now.exists() else None)
        out = [x for us, _, value in due for x in machine.take(us, value)] + machine.pass_to(until)
        kept = machine.kept()
        if kept is None:
            self.now.clear()
        else:
            self.now.update(kept)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        ahead = [r[0] for r in later] + ([machine.deadline()] if machine.deadline() is not None else [])
        if ahead:
            self._wake(min(ahead), expiredTimerInfo.getExpiryTimeInMs())
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=[self.key, "us", "state", "since", "n"]).astype({"since": "Int64"})

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, order: str, value: Column, late: str, machine: Callable, stored: str) -> DataFrame:
    """(key, us, state, since, n) of a machine over a stream; a null key is a key, rows without a time are left out."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    own = rows.where("ts is not null").select(key, F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce(F.col(order).cast("long"), F.lit(0)).alias("place"), value.cast("string").alias("value"))
    return own.withWatermark("ts", late).groupBy(key).transformWithStateInPandas(InOrder(machine, stored, key), f"`{key}` {kind}, us long, state string, since long, n long", "append", "eventTime")


def leases(releases: DataFrame, key: str, order: str, late: str, seconds: int = LEASE) -> DataFrame:
    """(key, ts, state, since, n) of a stream of releases (key, ts, order): a row where a lease begins and one where it has ended.

    A release while a lease runs makes it last ``seconds`` from then. n is the number of releases, 1 where a lease begins."""
    found = _run(releases, key, order, F.lit(None), late, _Made(Lease, seconds * US), "since long, until long, n long")
    return found.select(key, F.timestamp_micros("us").alias("ts"), "state", F.timestamp_micros("since").alias("since"), "n")


def link_log(probes: DataFrame, key: str, order: str, state: Column, late: str, seconds: int = SPARING) -> DataFrame:
    """(key, ts, state, contact, written) of a stream of probes: a row where a link's state changes and where its last contact is written.

    ``state`` is ``up``, ``degraded``, ``down`` or ``silent`` (no probe is made), null is ``unknown``. The last contact, the time of the last ``up``, is written
    when the link is no longer up, else where the last write was more than ``seconds`` ago; never while silent."""
    found = _run(probes, key, order, state, late, _Made(Link, seconds * US), "state string, contact long, written long, written_at long")
    return found.select(key, F.timestamp_micros("us").alias("ts"), "state", F.timestamp_micros("since").alias("contact"), (F.col("n") == 1).alias("written"))


class _Made:
    """machine(kept) with its length bound, by name so that workers can load it."""

    def __init__(self, kind: type, length: int):
        self.kind, self.length = kind, length

    def __call__(self, kept: tuple | None):
        return self.kind(kept, self.length)


def link_state(good: Column, names: Column) -> Column:
    """A probe's state from the number of targets that answered and whether names are resolved."""
    return F.when(good == 0, "down").when((good >= 2) & names, "up").otherwise("degraded")


def link_log_of(probes: DataFrame, key: str, order: str, state: Column, seconds: int = SPARING) -> DataFrame:
    """link_log() of a table: one sort by key and time, and a fold that holds one key's state as the rows stream by.

    A key's rows pass one task as a stream, of which a batch is in memory. Null keys are one key; rows without a time are left out."""
    kind = dict(probes.dtypes)[key]
    rows = probes.where("ts is not null").select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce(F.col(order).cast("long"), F.lit(0)).alias("place"), state.cast("string").alias("value"))
    rows = rows.repartition(key).sortWithinPartitions(key, "us", "place", "value")

    def run(batches):
        import pyarrow as pa

        now, machine = object(), None
        for batch in batches:
            out = []
            for k, us, value in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if machine is None or k != now:
                    now, machine = k, Link(None, seconds * US)
                out += [(k, *x) for x in machine.take(us, value)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], [key, "us", "state", "contact", "n"])

    ship(probes.sparkSession)
    found = rows.mapInArrow(run, f"`{key}` {kind}, us long, state string, contact long, n long")
    return found.select(key, F.timestamp_micros("us").alias("ts"), "state", F.timestamp_micros("contact").alias("contact"), (F.col("n") == 1).alias("written"))


def started(writer, spark) -> StreamingQuery:
    """writer.start() with the state store that timers need; the session's own setting is put back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)
