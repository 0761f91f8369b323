"""A folder of documents that is watched: a stream of changed files into a store, exactly once over stops, and a sweep for what a stream cannot see."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.snapshots import Snapshot, Store
from quillon.session import ship
from quillon.sources import folder as fd

FILES = f"{fd.SCHEMA}, version long"


def files(now: Snapshot) -> DataFrame:
    """The newest row of each path that is there; the table of all rows is joined on path and version, so texts are not sorted."""
    if "files" not in now:
        return now.store.spark.createDataFrame([], FILES)
    told = now.table("files")
    last = told.groupBy("path").agg(F.max("version").alias("version"))
    return told.join(last, ["path", "version"]).where("coalesce(error.kind, '') <> 'removed'").select("path", "size", "mtime", "hash", "kind", "title", "blocks", "error", "version")


def blocks(now: Snapshot) -> DataFrame:
    """(path, pos, text, heading, guessed) of all files that gave text."""
    return files(now).select("path", F.posexplode("blocks").alias("pos", "x")).select("path", "pos", "x.*")


def sink(store: Store, name: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds each batch to the store's files in one change with the batch's number.

    After a stop Spark gives the last batch again; where its number is there already nothing is added. ``name`` stands for one
    checkpoint: another checkpoint needs another name."""

    def run(batch: DataFrame, batch_id: int) -> None:
        note = f"batch of {name}"
        if store.snapshot().notes.get(note, -1) >= batch_id:
            return
        with store.change() as new:
            new.append("files", batch.withColumn("version", F.lit(new.version).cast("long")))
            new.notes[note] = batch_id

    return run


def watching(spark: SparkSession, folder: str, store: Store, name: str, checkpoint: str, quiet: float = 3, once: bool = False):
    """The started stream of a folder's changed files into a store; with ``once`` it reads what is there and ends."""
    fd.register(spark)
    changed = spark.readStream.format(fd.NAME).option("quiet", quiet).load(folder)
    trigger = {"availableNow": True} if once else {"processingTime": f"{max(quiet, 1)} seconds"}
    return changed.writeStream.foreachBatch(sink(store, name)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def sweep(spark: SparkSession, folder: str, store: Store) -> Snapshot:
    """One pass over the whole folder for what dates of change do not tell: files that are gone, that came with an old date, or that could not be read.

    Names, sizes and dates are compared; only files that differ or wait are opened. Where nothing differs the store stays at its version."""
    fd.register(spark)
    known = files(store.snapshot()).select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), (F.col("error.kind") == "retry").alias("_waits"), F.lit(True).alias("_known"))
    there = spark.read.format(fd.NAME).option("content", "false").load(folder).select("path", "size", "mtime", F.lit(True).alias("_there"))
    both = there.join(known, "path", "full_outer")
    gone = both.where("_there is null").select("path", *[F.lit(None).cast(t).alias(c) for c, t in _types(spark).items() if c not in ("path", "error")], F.struct(F.lit("removed").alias("kind"), F.lit("no longer there").alias("message")).alias("error"))
    due = both.where("_there and (_known is null or coalesce(_waits, false) or size <> _size or mtime <> _mtime)").select("path", "size", "mtime")

    def read(batches):
        import pyarrow as pa

        kinds = {"hash": pa.string(), "kind": pa.string(), "title": pa.string(), "blocks": pa.list_(pa.struct([("text", pa.string()), ("heading", pa.bool_()), ("guessed", pa.bool_())])), "error": pa.struct([("kind", pa.string()), ("message", pa.string())])}
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                *plain, parts, error = next(fd.rows(fd.Lot(folder, [row])))
                parts = None if parts is None else [dict(zip(("text", "heading", "guessed"), x, strict=True)) for x in parts]
                error = None if error is None else dict(zip(("kind", "message"), error, strict=True))
                values = dict(zip(("hash", "kind", "title", "blocks", "error"), (*plain[3:], parts, error), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.int64()), *(pa.array([values[c]], t) for c, t in kinds.items())], ["path", "size", "mtime", *kinds])

    ship(spark)
    base = store.snapshot()
    if both.where("_there is null or _known is null or coalesce(_waits, false) or size <> _size or mtime <> _mtime").isEmpty():
        return base
    with store.change() as new:
        found = due.mapInArrow(read, fd.SCHEMA).unionByName(gone)
        new.append("files", found.withColumn("version", F.lit(new.version).cast("long")))
    return store.snapshot()


def compact(store: Store) -> Snapshot:
    """The files in one part, without rows that no longer count."""
    with store.change() as new:
        new.put("files", files(new.base))
    return store.snapshot()


def _types(spark: SparkSession) -> dict[str, str]:
    return dict(spark.createDataFrame([], fd.SCHEMA).dtypes)
