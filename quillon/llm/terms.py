"""Words of the searches and scans: runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are lower-cased."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import free, stage

#: What stands between words, before lower-casing.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: The same over UTF-8 bytes: separators become blanks, A-Z become a-z, bytes of other characters stay.
BYTES = bytes(c | 32 if chr(c) in string.ascii_uppercase else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are. Native."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def split_words(text: Column) -> Column:
    """The words of a text as written, in order; null has none. Native."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS), "")


def byte_words(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a UTF-8 text, in order; None has none."""
    return (text or b"").translate(BYTES).split()


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with the number of each row, from 1, in the order given, over all rows.

    Rows are sorted over ranges of the order and written; a row's number is its place in its range after the sizes of the ranges
    before, so no task sees more than a range and only the sizes of ranges, one for each partition, pass the driver. Rows that
    are equal in the order are numbered in any order.
    """
    at = free(df, "_at")
    laid = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(at, 33)
    sizes = sorted(map(tuple, laid.groupBy(part.alias("part")).count().collect()))
    before, rows = 0, []
    for k, n in sizes:
        rows.append((k, before))
        before += n
    part_, before_ = free(df, "_part"), free(df, "_before")
    offsets = df.sparkSession.createDataFrame(rows, f"{part_} long, {before_} long")
    place = F.col(before_) + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return laid.withColumn(part_, part).join(F.broadcast(offsets), part_).withColumn(name, place).drop(at, part_, before_)


def duck_words(column: str) -> str:
    """The words of a text in DuckDB's dialect."""
    lower = f"translate(coalesce({column}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


