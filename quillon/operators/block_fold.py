"""Clean-up of a document's blocks in order: a fold with carried state over rows that stream by, one sort for each document.

Running headers and page numbers go, a figure that stands alone waits for the block after it, short blocks are joined to the one
before, and of two headings in a row a guessed first one is text. The fold holds one block and one pending figure, however long
the document is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import ship

#: Characters below which a block is a short one; up to which it may take short ones; below which it may be a running header; times that make it one.
SHORT, ROOM, HEADER, TIMES = 40, 200, 150, 3
FIGURE = r"[\d\s.,:%€$+×xX/|-]+"
PAGE_NUMBER = r"(?i)page\s*\d+(\s*[/|]\s*\d+)?"


@dataclass
class Block:
    text: str
    heading: bool = False
    guessed: bool = False
    page: int | None = None


class Fold:
    """Blocks of one document in, cleaned blocks out; take() and end() return those that are final."""

    def __init__(self) -> None:
        self.pending, self.held = "", None

    def push(self, block: Block) -> list[Block]:
        before, self.held = self.held, block
        if before is None:
            return []
        if before.heading and before.guessed and block.heading:
            before.heading = False
        return [before]

    def take(self, block: Block, times: int) -> list[Block]:
        text = block.text.strip()
        figure = re.fullmatch(FIGURE, text) is not None
        if times >= TIMES and not figure and len(block.text) < HEADER:
            return []
        if block.page and (figure or re.fullmatch(PAGE_NUMBER, text)):
            return []
        if figure and not block.heading:
            self.pending = f"{self.pending} {text}".strip()
            return []
        if self.pending:
            block.text, self.pending = f"{self.pending} · {block.text}", ""
        if block.heading and sum(c.isalpha() for c in block.text) < 3:
            return []
        last = self.held
        if last and not (block.heading or last.heading) and len(block.text) < SHORT and len(last.text) < ROOM and last.page == block.page:
            last.text = f"{last.text} · {block.text}"
            return []
        return self.push(block)

    def end(self) -> list[Block]:
        out = self.push(Block(self.pending)) if self.pending else []
        return [*out, self.held] if self.held else out


def folded(blocks: DataFrame, key: str = "doc_id", most: int = 4096) -> DataFrame:
    """(key, pos, text, heading, page): the cleaned blocks of blocks (key, pos, text, heading, guessed, page), in order from 0.

    A shape, the lower-cased text with numbers as #, that comes TIMES times in a document is a running header. Null text counts
    as empty and goes; a null key is a document; rows at the same place stand in the order of their texts. A document is
    one stream in one task, of which the fold holds one block."""
    shape = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\d+", "#"), r"\s+", " "))
    rows = blocks.where("trim(text) <> ''").select(F.col(key).alias("key"), "pos", "text", F.coalesce("heading", F.lit(False)).alias("heading"), F.coalesce("guessed", F.lit(False)).alias("guessed"), F.col("page").cast("int").alias("page"))
    rows = rows.withColumn("times", F.when(F.length("text") < HEADER, F.count("*").over(Window.partitionBy("key", shape))).otherwise(F.lit(0)).cast("long"))
    rows = rows.repartition("key").sortWithinPartitions("key", "pos", "text")
    kind = dict(blocks.dtypes)[key]

    def run(batches):
        import pyarrow as pa

        now, fold, n, out, type_ = object(), None, 0, [], None

        def emit(found):
            nonlocal n
            for b in found:
                out.append((now, n, b.text, b.heading, b.page))
                n += 1

        def batch_of():
            cols = list(zip(*out, strict=True)) or [[]] * 5
            made = [pa.array(c, t) for c, t in zip(cols, (type_, pa.int32(), pa.string(), pa.bool_(), pa.int32()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, [key, "pos", "text", "heading", "page"])

        for batch in batches:
            type_ = batch.column(0).type
            for doc, text, heading, guessed, page, times in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6)), strict=True):
                if fold is None or doc != now:
                    emit(fold.end() if fold else [])
                    now, fold, n = doc, Fold(), 0
                emit(fold.take(Block(text, heading, guessed, page), times))
                if len(out) >= most:
                    yield batch_of()
        if fold:
            emit(fold.end())
            yield batch_of()

    ship(blocks.sparkSession)
    return rows.mapInArrow(run, f"`{key}` {kind}, pos int, text string, heading boolean, page int")


def chapters(lines: DataFrame, key: str, pos: str, header: str) -> DataFrame:
    """lines with ``chapter``: the last header seen; an empty header says that there is none from here on, a null one that nothing is known."""
    seen = F.when(F.col(header).isNotNull(), F.struct(F.col(header).alias("h")))
    last = F.last(seen, ignorenulls=True).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("chapter", F.when(last["h"] != "", last["h"]))
