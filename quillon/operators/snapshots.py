"""Several Parquet tables that change together: a manifest names the folders of all of them, and readers hold one manifest.

A change writes new folders beside the old ones and then makes the next manifest by one rename that fails where the name is taken.
A job that dies before the rename leaves folders that no manifest names; the state stays as it was. Two writers of one version
cannot both succeed. clean() deletes what no kept manifest names.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Conflict(RuntimeError):
    """Another change has made this version first."""


class Store:
    """A folder of tables in any store that Spark reads and that renames files atomically."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._root = self._fs.Path(self.path).getFileSystem(self._conf)

    def _at(self, *parts: str):
        return self._fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        """The versions there are, oldest first."""
        folder = self._at("manifests")
        if not self._root.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._root.listStatus(folder)]
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest state, or that of a version; later changes do not move it. Version 0 is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Snapshot(self, 0, {}, {})
        told = json.loads(self.spark.read.text(f"{self.path}/manifests/{version:020d}.json", wholetext=True).first()[0])
        return Snapshot(self, version, told["tables"], told["notes"])

    def change(self) -> Change:
        """with store.change() as c: c.put(...); everything is there at the end of the block, or nothing where it raises."""
        return Change(self, self.snapshot())

    def clean(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions, and folders that no kept one names. Not while a change is being written."""
        versions = self.versions()
        gone, kept = versions[:-keep], versions[-keep:]
        named = {part for v in kept for t in self.snapshot(v).tables.values() for part in t["parts"]}
        for v in gone:
            self._root.delete(self._at("manifests", f"{v:020d}.json"), False)
        if self._root.exists(self._at("data")):
            for x in self._root.listStatus(self._at("data")):
                if x.getPath().getName() not in named:
                    self._root.delete(x.getPath(), True)

    def _commit(self, version: int, tables: dict, notes: dict) -> None:
        text = json.dumps({"tables": tables, "notes": notes}, sort_keys=True)
        self._root.mkdirs(self._at("manifests"))
        draft = self._at(f"draft-{uuid.uuid4().hex}")
        out = self._root.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        no_options = gateway.new_array(kind, 0)
        files = self._fs.FileContext.getFileContext(self._root.getUri(), self._conf)
        target = self._root.makeQualified(self._at("manifests", f"{version:020d}.json"))
        try:
            files.rename(self._root.makeQualified(draft), target, no_options)
        except Exception as e:
            self._root.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is there already") from e
            raise


class Snapshot:
    """The tables and notes of one version."""

    def __init__(self, store: Store, version: int, tables: dict[str, Any], notes: dict[str, Any]):
        self.store, self.version, self.tables, self.notes = store, version, tables, notes

    def table(self, name: str) -> DataFrame:
        """A table of this version; its parts are read as one."""
        told = self.tables[name]
        schema = StructType.fromJson(told["schema"])
        read = self.store.spark.read.schema(schema)
        parts = [read.parquet(f"{self.store.path}/data/{x}") for x in told["parts"]]
        return reduce(DataFrame.unionByName, parts) if parts else self.store.spark.createDataFrame([], schema)

    def __contains__(self, name: str) -> bool:
        return name in self.tables


class Change:
    """New parts of tables, written as they are given and named together at the end."""

    def __init__(self, store: Store, base: Snapshot):
        self.store, self.base = store, base
        self.version = base.version + 1
        self.tables, self.notes = {k: dict(v) for k, v in base.tables.items()}, dict(base.notes)

    def _write(self, df: DataFrame, by: str | None) -> str:
        part = uuid.uuid4().hex
        writer = df.write.partitionBy(by) if by else df.write
        conf = self.store.spark.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")  # the shuffle files of this job go with it
        try:
            writer.parquet(f"{self.store.path}/data/{part}")
        finally:
            conf.set(CLEANUP, before)
        return part

    def put(self, name: str, df: DataFrame, by: str | None = None) -> None:
        """Replace a table; ``by`` names a column whose values get folders of their own."""
        self.tables[name] = {"schema": df.schema.jsonValue(), "parts": [self._write(df, by)]}

    def append(self, name: str, df: DataFrame, by: str | None = None) -> None:
        """Add a part to a table."""
        old = self.tables.get(name, {"parts": []})["parts"]
        self.tables[name] = {"schema": df.schema.jsonValue(), "parts": [*old, self._write(df, by)]}

    def drop(self, name: str) -> None:
        """Take a table out that this change has put, with its folder; for what only the change itself reads."""
        for part in self.tables.pop(name)["parts"]:
            self.store._root.delete(self.store._at("data", part), True)

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.store._commit(self.version, self.tables, self.notes)
