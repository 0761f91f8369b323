"""Marks around the words of a question in a short text: zones found in the normalised text, chosen from left to right, set in the raw one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import rules
from quillon.functions import text as tx


def zones(text: Column, words: Column) -> Column:
    """array<struct<a, b>>: where words (normalised) begin a word of text, as places from 0 in the raw text, in order; all of them, overlapping ones too.

    Meant for excerpts: the work grows with the length of the text times the number of words."""

    def of(x: Column) -> Column:
        normal, at, size = x["normal"], x["at"], x["size"]
        starts = lambda m: F.filter(F.sequence(F.lit(1), F.length(normal)), lambda i: (F.substr(normal, i, F.length(m)) == m) & ((i == 1) | ~F.substr(normal, i - 1, F.lit(1)).rlike("[\\p{L}\\p{N}]")))
        place = lambda m: F.transform(starts(m), lambda i: F.struct(F.get(at, i - 1).alias("a"), F.coalesce(F.get(at, i - 1 + F.length(m)), size).alias("b")))
        found = F.flatten(F.transform(F.filter(words, lambda m: F.length(m) > 0), place))
        return F.when(F.length(normal) > 0, F.array_sort(found, lambda p, q: p["a"] - q["a"]))

    return tx.once(F.struct(tx.normalize(text).alias("normal"), rules.positions(text).alias("at"), F.length(text).alias("size")), of)


def chosen(found: Column) -> Column:
    """Of zones in order, those that begin at or after the end of the one chosen before."""
    none = F.expr("cast(array() as array<struct<a: int, b: int>>)")
    start = F.struct(F.lit(0).alias("end"), none.alias("kept"))
    step = lambda acc, z: F.when(z["a"] < acc["end"], acc).otherwise(F.struct(z["b"].alias("end"), F.array_append(acc["kept"], z).alias("kept")))
    return F.aggregate(F.coalesce(found, none), start, step, lambda acc: acc["kept"])


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def marked(text: Column, words: Column, before: str = "<b>", after: str = "</b>") -> Column:
    """text, escaped for HTML, with marks around the chosen zones; every mark is closed, and none lies in another. Null stays null."""
    part = lambda a, b: escaped(F.substr(text, a + 1, b - a))
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("html"))
    step = lambda acc, z: F.struct(z["b"].alias("end"), F.concat(acc["html"], part(acc["end"], z["a"]), F.lit(before), part(z["a"], z["b"]), F.lit(after)).alias("html"))
    return F.aggregate(chosen(zones(text, words)), start, step, lambda acc: F.concat(acc["html"], part(acc["end"], F.length(text))))
