"""Values as text: canonical JSON and the order of names in a language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """A JSON text with its keys in order at every level and without blanks, so that equal values have equal texts; null for what is no JSON or repeats a key.

    Numbers are written as the engine writes them: 1.0 and 1 differ, 1e2 and 100.0 do not."""
    return F.to_json(F.try_parse_json(text))


def text_field(parsed: Column, path: str, most: int = 200) -> Column:
    """A field of a VARIANT as trimmed text of at most ``most`` characters; null for other types and empty text."""
    found = F.try_variant_get(parsed, path, "string")
    plain = F.when(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING", F.left(F.trim(found), F.lit(most)))
    return F.nullif(plain, F.lit(""))


def in_language(name: Column, language: str = "fr") -> Column:
    """A name to sort by as a language orders it: letters first, then accents, then case."""
    return F.collate(name, language)
