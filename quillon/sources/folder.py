"""A Spark data source over a folder of mixed documents, as a table and as a stream: spark.read.format("folder_documents").

Files are dispatched by format to blocks of text. A file that gives none is a row with a typed error, never a failed job. The driver lists
names, sizes and dates, as Spark's own file index does; contents are read by tasks of about ``bytes`` each, whole files up to LARGEST bytes.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillon.session import ship
from quillon.sources import extract

LARGEST = 64 << 20
NAME = "folder_documents"
SCHEMA = "path string, size long, mtime long, hash string, kind string, title string, blocks array<struct<text string, heading boolean, guessed boolean>>, error struct<kind string, message string>"


@dataclass
class Lot(InputPartition):
    """Files (path, size, mtime) that one task reads."""

    root: str
    files: list[tuple[str, int, int]]


def opened(root: str):
    """(file system, folder in it) of a path or address."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}")
    return system, path.rstrip("/")


def listed(root: str) -> Iterator[tuple[str, int, int]]:
    """(path below root, size, mtime in milliseconds) of all files; names that begin with a dot and symbolic links are left out, an unreadable folder is empty."""
    from pyarrow import fs

    system, top = opened(root)
    local, folders = isinstance(system, fs.LocalFileSystem), [top]
    while folders:
        try:
            found = system.get_file_info(fs.FileSelector(folders.pop(), recursive=False))
        except OSError:
            continue
        for x in found:
            if x.base_name.startswith(".") or (local and os.path.islink(x.path)):
                continue
            if x.type == fs.FileType.Directory:
                folders.append(x.path)
            elif x.type == fs.FileType.File:
                yield x.path[len(top) + 1 :], x.size, (x.mtime_ns or 0) // 1_000_000


def rows(lot: Lot, content: bool = True) -> Iterator[tuple]:
    """A row of SCHEMA for each file. Unsupported formats are not opened; what cannot be read now has the error kind ``retry``."""
    system = opened(lot.root) if content else None
    for path, size, mtime in lot.files:
        kind, digest, title, blocks, error = extract.kind_of(path), None, None, None, None
        if content:
            try:
                if kind in (None, "pdf"):
                    raise extract.Refused("unsupported", f"format not supported ({kind or 'unknown'})")
                if size > LARGEST:
                    raise extract.Refused("too large", f"{size} bytes")
                with system[0].open_input_stream(f"{system[1]}/{path}") as file:
                    data = file.read()
                digest = hashlib.sha256(data).hexdigest()
                title, blocks = extract.text_of(path, data, LARGEST)
            except extract.Refused as e:
                error = (e.kind, str(e))
            except OSError as e:
                error = ("retry", type(e).__name__)
        yield path, size, mtime, digest, kind, title, blocks, error


def lots(root: str, files: Iterator[tuple[str, int, int]], most: int, cost: int = 4 << 20) -> list[Lot]:
    """Files dealt in order of path to lots of about ``most`` bytes, opening one counting as ``cost``."""
    out, size = [], most
    for x in sorted(files):
        weight = min(x[1], LARGEST) + cost
        if not out or size + weight > most:
            out.append(Lot(root, []))
            size = 0
        out[-1].files.append(x)
        size += weight
    return out


class _Options:
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("load() needs the path of a folder")
        self.root = options["path"]
        self.most = int(options.get("bytes", 128 << 20))
        self.quiet = float(options.get("quiet", 3))
        self.content = options.get("content", "true").lower() == "true"


class _Table(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = _Options(options)

    def partitions(self) -> list[Lot]:
        return lots(self.options.root, listed(self.options.root), self.options.most) or [Lot(self.options.root, [])]

    def read(self, partition: Lot) -> Iterator[tuple]:
        return rows(partition, self.options.content)


class _Stream(DataSourceStreamReader):
    """Offsets are dates of change: a batch has the files changed after one and up to another. A file that was changed within the last
    ``quiet`` seconds holds back only itself and later ones, so a burst of changes is read once, when it is over."""

    def __init__(self, options: dict[str, str]):
        self.options = _Options(options)

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self, *_) -> dict:
        calm = int((time.time() - self.options.quiet) * 1000)
        return {"until": max((x[2] for x in listed(self.options.root) if x[2] <= calm), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Lot]:
        return lots(self.options.root, (x for x in listed(self.options.root) if start["until"] < x[2] <= end["until"]), self.options.most)

    def read(self, partition: Lot) -> Iterator[tuple]:
        return rows(partition, self.options.content)

    def commit(self, end: dict) -> None:
        pass


class FolderDocuments(DataSource):
    """Options: path; ``bytes`` a task reads (128 MB); ``content`` false for names, sizes and dates only; ``quiet`` seconds, 3, in a stream."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Table(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and its executors."""
    ship(spark)
    spark.dataSource.register(FolderDocuments)
