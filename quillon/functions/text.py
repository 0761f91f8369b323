"""Text analysis as Column expressions: normalising, words, phrases, hits."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to be required, apostrophes that count as one, ligatures and their spelling.
COMMON = ["de", "la", "le", "les", "du", "des", "un", "une", "et", "en", "au", "aux", "a", "ou", "sur", "par", "pour", "dans"]
APOSTROPHES = "’‘`´ʼ"
LIGATURES = {"œ": "oe", "Œ": "oe", "æ": "ae", "Æ": "ae", "ß": "ss"}
WORD = "[\\p{L}\\p{N}]+"


# What counts as white space: the controls, the no-break space and the blanks of other widths.
BLANKS = "\t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _folding() -> tuple[str, str]:
    """Letters with marks and their bare forms, from Unicode's own decompositions, then the marks themselves, which have none; letters
    whose decomposition has several letters stay."""
    bare = lambda c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M")
    every = [c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000]
    pairs = [(c, b) for c in every if len(b := bare(c)) == 1 and b != c]
    return "".join(a for a, _ in pairs) + "".join(c for c in every if not bare(c)), "".join(b for _, b in pairs)


ACCENTED, BARE = _folding()


def normalize(text: Column) -> Column:
    """Lower case without accents, of whole letters or as marks of their own; ligatures spelt out, apostrophes unified, any white space a blank."""
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    plain = APOSTROPHES + BLANKS
    return F.lower(F.translate(text, plain + ACCENTED, "'" * len(APOSTROPHES) + " " * len(BLANKS) + BARE))


def tokens(text: Column) -> Column:
    """Words of a normalised text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def query_words(text: Column) -> Column:
    """At most 8 distinct words of two letters or more from the first 200 characters; common ones only if nothing else is left."""
    found = F.array_distinct(F.filter(tokens(normalize(F.substring(text, 1, 200))), lambda x: F.length(x) >= 2))
    useful = F.filter(found, lambda x: ~x.isin(COMMON))
    return F.slice(F.when(F.size(useful) > 0, useful).otherwise(found), 1, 8)


def phrase(text: Column) -> Column:
    """The question as one normalised phrase, common words included; null for a single word."""
    found = F.trim(F.regexp_replace(normalize(F.substring(text, 1, 200)), "[^\\p{L}\\p{N}']+", " "))
    return F.when(F.contains(found, F.lit(" ")), found)


def hits(text: Column, word: str, most: int | None = None) -> Column:
    """How often a normalised text has a word beginning with ``word``, at most ``most``."""
    n = F.size(F.regexp_extract_all(text, F.lit("(?<![\\p{L}\\p{N}])" + re.escape(word)), F.lit(0)))
    return F.least(n, F.lit(most)) if most else n


def occurrences(words: Column, word: str, whole_below: int = 5, most: int = 10) -> Column:
    """Hits among tokens: short query words must match whole, longer ones may be a prefix; at most ``most``."""
    test = (lambda x: x == word) if len(word) < whole_below else (lambda x: x.startswith(word))
    return F.least(F.size(F.filter(words, test)), F.lit(most))


#: The same rules in the oracle's dialect.
SQL_BARE = "replace(replace(replace(replace(replace({0},'œ','oe'),'Œ','oe'),'æ','ae'),'Æ','ae'),'ß','ss')"
SQL_NORMALIZE = f"lower(strip_accents(translate({SQL_BARE}, '’‘`´ʼ' || chr(9) || chr(10) || chr(13) || chr(160), '''''''''''    ')))"


def sql_normalize(column: str) -> str:
    return SQL_NORMALIZE.format(column)


def byte_size(n: str) -> Column:
    """A size in bytes as people read it: one decimal below ten units of kilobytes, and for megabytes."""
    c = F.col(n)
    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" o")))
        .when(c < 10240, F.concat(F.round(c / 1024, 1).cast("string"), F.lit(" Ko")))
        .when(c < 1048576, F.concat(F.round(c / 1024).cast("long").cast("string"), F.lit(" Ko")))
        .otherwise(F.concat(F.round(c / 1048576, 1).cast("string"), F.lit(" Mo")))
    )


def once(value: Column, use) -> Column:
    """use(value) with value computed once a row: it is bound to a lambda's variable, so the optimizer cannot copy it into each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
