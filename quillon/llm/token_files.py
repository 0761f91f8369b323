"""Token ids as seekable zstandard files (operator 8).

A file is a row of independent zstandard frames of 65,536 ids each (little-endian unsigned 32-bit), one skippable frame with the
documents' ids and lengths (an Arrow stream, zstandard again), and a trailing seek table as zstandard's seekable format lays it
out: for each frame its compressed size, its size and the low 32 bits of its content's XXH64, then the number of frames, a
descriptor byte and a magic number. A reader takes the tail, then only the frames that hold the documents it wants.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import make_dir, new_path, stage, word_ids

#: Fixed values of the zstandard seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME = 65536


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _sum32(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def write_file(uri: str, docs: Iterator[tuple[int | None, bytes]], level: int = 3) -> tuple[int, int]:
    """Write (doc_id, id bytes) in the order given; (documents, ids) written. Written aside and moved, so a retried task leaves one whole file."""
    import pyarrow as pa
    import zstandard

    store, path = _store(uri)
    aside = f"{path}.{uuid.uuid4().hex}"
    press = zstandard.ZstdCompressor(level=level)
    table, ids, lengths, held = [], [], [], bytearray()
    with store.open_output_stream(aside) as out:

        def frame(data: bytes) -> None:
            packed = press.compress(data)
            out.write(packed)
            table.append((len(packed), len(data), _sum32(data)))

        for doc, data in docs:
            ids.append(doc)
            lengths.append(len(data) // 4)
            held += data
            while len(held) >= 4 * FRAME:
                frame(bytes(held[: 4 * FRAME]))
                del held[: 4 * FRAME]
        if held:
            frame(bytes(held))
        sink = pa.BufferOutputStream()
        index = pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(lengths, pa.int64())})
        with pa.ipc.new_stream(sink, index.schema) as writer:
            writer.write_table(index)
        body = press.compress(sink.getvalue().to_pybytes())
        out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        table.append((len(body) + 8, 0, _sum32(body)))
        rows = b"".join(struct.pack("<III", *x) for x in table)
        out.write(struct.pack("<II", SEEK_TABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(table), WITH_CHECKSUMS, SEEKABLE))
    store.move(aside, path)
    return len(ids), sum(lengths)


class TokenFile:
    """Reader of one file: ids of chosen documents, decompressing only the frames that hold them."""

    def __init__(self, uri: str):
        import pyarrow as pa
        import zstandard

        store, path = _store(uri)
        self.file, self.open = store.open_input_file(path), zstandard.ZstdDecompressor().decompress
        end = self.file.size()
        n, kind, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or kind != WITH_CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        start = end - 9 - 12 * n
        self.table = np.frombuffer(self._at(start, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        body = self._at(int(self.places[n - 1]) + 8, int(self.table[n - 1, 0]) - 8)
        if _sum32(body) != self.table[n - 1, 2]:
            raise ValueError(f"{uri}: the document list is damaged")
        index = pa.ipc.open_stream(self.open(body)).read_all()
        self.doc_ids, self.lengths = index.column("doc_id").to_pylist(), np.asarray(index.column("n"))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.last, self.frames_read = (-1, b""), 0

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            data = self.open(self._at(int(self.places[k]), int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
            if _sum32(data) != self.table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.last, self.frames_read = (k, data), self.frames_read + 1
        return self.last[1]

    def document(self, at: int) -> bytes:
        """Id bytes of the document at a place in the file."""
        a, b = int(self.starts[at]), int(self.starts[at + 1])
        if a == b:
            return b""
        parts = [self.frame(k)[max(0, a - k * FRAME) * 4 : (b - k * FRAME) * 4] for k in range(a // FRAME, (b - 1) // FRAME + 1)]
        return parts[0] if len(parts) == 1 else b"".join(parts)


def write(docs: DataFrame, vocabulary: str, end: int = 2, folder: str | None = None) -> DataFrame:
    """Write all texts, in ascending doc_id order over the files too; (shard, uri, n_docs, n_ids), one row a file.

    Null doc_ids come first and stay null; rows that repeat a doc_id stay apart, in the order of their texts; a null text is
    empty and has the end id only. An empty table gives no files.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    make_dir(spark, folder)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def run(batches):
        import pyarrow as pa

        ids, stop = word_ids(vocabulary), np.array([end], "<u4").tobytes()
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        shard = first.column(2)[0].as_py()

        def each():
            batch = first
            while batch is not None:
                for doc, found in zip(batch.column(0).to_pylist(), ids.texts(batch.column(1).cast(pa.binary()).to_pylist()), strict=True):
                    yield doc, found + stop
                batch = next(batches, None)

        uri = f"{folder}/shard-{shard:06d}.zst"
        n_docs, n_ids = write_file(uri, each())
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([uri]), pa.array([n_docs]), pa.array([n_ids])], ["shard", "uri", "n_docs", "n_ids"])

    return stage(rows.mapInArrow(run, "shard long, uri string, n_docs long, n_ids long"), "shards")


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start counts the ids of all documents before it."""
    n = max(1, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    rows = shards.select("uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")).repartition(n)

    def run(batches):
        from zlib import crc32

        import pyarrow as pa

        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(uri)
                sums = [crc32(file.document(k)) for k in range(len(file.doc_ids))]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(file.starts[:-1] + base), pa.array(file.lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
