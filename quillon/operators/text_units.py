"""Blocks, paragraphs, sections and n-grams of texts and pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.session import ship
from quillon.sources import extract

HEADING = r"^[\p{Lu}\p{N}].*"


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, block): the lines of a text that are not blank."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "block")).where("trim(block) <> ''")


def is_heading(block: str = "block"):
    """At most 80 characters, begins with a capital or digit, has a letter, no final punctuation."""
    c = F.trim(F.col(block))
    return (F.length(c) <= 80) & c.rlike(HEADING) & c.rlike(r"\p{L}") & ~c.rlike(r"[.!?:;,]$")


def repeated(lines: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """(key, shape, times): lines that repeat in a document when digits are read as #."""
    shape = F.regexp_replace(F.lower(F.trim("block")), "[0-9]+", "#")
    return lines.select(key, shape.alias("shape")).groupBy(key, "shape").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def format_blocks(df: DataFrame, key: str, text: str, form: str) -> DataFrame:
    """(key, pos, text, heading, guessed) of texts in one format, ``txt``, ``md`` or ``html``, by the rules of the folder reader.

    Null and empty texts have no rows; null and repeated keys are kept apart only by their rows."""
    read = {"txt": lambda x: extract.paragraphs(x.replace("\r\n", "\n").replace("\r", "\n")), "md": lambda x: extract.markdown(x)[1], "html": lambda x: extract.page(x)[1]}[form]
    kind = dict(df.dtypes)[key]

    def run(batches):
        import pyarrow as pa

        types = (pa.int32(), pa.string(), pa.bool_(), pa.bool_())
        for batch in batches:
            out = [(k, pos, *x) for k, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for pos, x in enumerate(read(one or ""))]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.column(0).type, *types), strict=True)], [key, "pos", "text", "heading", "guessed"])

    ship(df.sparkSession)
    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, pos int, text string, heading boolean, guessed boolean")


def elements(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, body): headings, paragraphs and list items of pages, scripts, styles and comments left out."""
    clean = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all(clean, F.lit(r"(?is)<(?:h[1-4]|p|li|dd)\b[^>]*>.*?</(?:h[1-4]|p|li|dd)>"), F.lit(0))).alias("pos", "x"))
    body = F.trim(F.regexp_replace(F.regexp_replace("x", "<[^>]*>", " "), r"\s+", " "))
    return found.select("page_id", "pos", F.lower(F.regexp_extract("x", r"^<(\w+)", 1)).alias("tag"), body.alias("body"))


def with_section(parts: DataFrame) -> DataFrame:
    """elements() with the heading that each element stands under; carried forward within a page."""
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("section", F.last(F.when(F.col("tag").rlike("^h[1-4]$"), F.col("body")), True).over(w))


def ngrams(words, n: int = 5):
    """Array of n-grams of an array of words, joined by a blank."""
    some = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return tx.once(words, lambda w: F.when(F.size(w) >= n, some(w)).otherwise(F.array().cast("array<string>")))


def packed_chunks(lines: DataFrame, target: int = 400, key: str = "doc_id") -> DataFrame:
    """(key, chunk, n_blocks, tokens): blocks dealt into chunks by running size, a token being four characters."""
    size = F.ceil(F.length("block") / 4)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / target)
    return lines.withColumn("chunk", at).groupBy(key, "chunk").agg(F.count("*").alias("n_blocks"), F.sum(size).alias("tokens"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): the inverted index. Texts are dealt by key, four tasks for each of the scan's, so words are counted where they are
    and what is grouped by key afterwards needs no other shuffle."""
    tasks = max(4 * docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    words = docs.select(key, text).repartition(tasks, key).select(key, F.explode(tx.tokens(tx.normalize(F.col(text)))).alias("term"))
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"))


def pieces(block: str, most: int) -> list[str]:
    """A block cut into parts of at most ``most`` tokens of four characters, at sentence ends, else at blanks, else anywhere."""
    limit, out = 4 * most, []
    while len(block) > limit:
        ends = [m.end() for m in re.finditer(r"[.!?]\s", block[: limit + 1])] or [m.end() for m in re.finditer(r"\s", block[: limit + 1])]
        cut = min(ends[-1], limit) if ends else limit
        out.append(block[:cut].strip())
        block = block[cut:]
    return [x for x in [*out, block.strip()] if x]


def pack_blocks(blocks: list[tuple[str, bool]], target: int = 400, overlap: int = 55, least: int = 25) -> list[tuple[str | None, str]]:
    """(section, text) of each chunk: blocks are joined by a blank line up to ``target`` tokens; a heading closes a chunk of at
    least ``least`` tokens; a chunk that follows another of its section begins with the last ``overlap`` tokens of that one's new text."""
    out: list[tuple[str | None, str]] = []
    section, tail, fresh = None, "", []
    size = lambda x: -(-len(x) // 4)

    def close(carry: bool) -> None:
        nonlocal tail, fresh
        if fresh:
            new = "\n\n".join(fresh)
            out.append((section, f"{tail}\n\n{new}" if tail else new))
            tail = new[-4 * overlap :].partition(" ")[2] if carry else ""
        elif not carry:
            tail = ""
        fresh = []

    for text, heading in blocks:
        if heading:
            if size("\n\n".join(fresh)) >= least or not fresh:
                close(False)
                section = text
                continue
            fresh.append(text)
            continue
        for part in pieces(text, target - overlap) if size(text) > target else [text]:
            if fresh and size("\n\n".join([tail, *fresh, part] if tail else [*fresh, part])) > target:
                close(True)
            fresh.append(part)
    close(False)
    return out


def chunks(docs: DataFrame, target: int = 400, overlap: int = 55) -> DataFrame:
    """(doc_id, rank, section, text): the documents' chunks, by a fold over each document's blocks in Arrow batches.

    A null text has no chunk."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [(x, heading_like(x)) for x in map(str.strip, (text or "").split("\n")) if x]
                rows += [(doc, k, section, chunk) for k, (section, chunk) in enumerate(pack_blocks(own, target, overlap))]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["doc_id", "rank", "section", "text"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, rank int, section string, text string")


def heading_like(x: str) -> bool:
    """is_heading() for one block in Python."""
    return len(x) <= 80 and (x[0].isupper() or x[0].isnumeric()) and any(c.isalpha() for c in x) and x[-1] not in ".!?:;,"
