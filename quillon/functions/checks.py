"""Entries of catalogues and settings as parsed JSON (VARIANT): the first rule that one breaks, or the fields with defaults for what is no use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.values import text_field

# Shapes of identifiers, language codes, hashes, addresses, names of avatars and colours; fields of a book that are texts.
SLUG = "^[a-z0-9]+(-[a-z0-9]+)*\\z"
CODE = "^[a-z]{2,3}(-[a-z]{2,4})?\\z"
SHA256 = "^[0-9a-f]{64}\\z"
HTTPS = "^https://[^\\s]+\\z"
AVATAR, COLOUR = "^[a-z]{3,16}\\z", "(?i)^#[0-9a-f]{6}\\z"
BOOK_TEXTS = ["titre", "editeur", "langue", "categorie", "attribution"]
LENGTHS = ["courte", "adaptee", "detaillee"]


def kind(parsed: Column, path: str) -> Column:
    """Type of a field as the engine names it, '' where there is none."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")), F.lit(""))


def is_text(parsed: Column, path: str = "$", shape: str = "\\S") -> Column:
    """A text in which ``shape`` is found; by default one that is not blank."""
    return F.coalesce((kind(parsed, path) == "STRING") & F.try_variant_get(parsed, path, "string").rlike(shape), F.lit(False))


def is_whole(parsed: Column, path: str, least: int) -> Column:
    """A whole number, 5.0 being one, of ``least`` or more."""
    number = kind(parsed, path).rlike("^(BIGINT|DECIMAL|DOUBLE)")
    value = F.try_variant_get(parsed, path, "double")
    return F.coalesce(number & (value == F.floor(value)) & (value >= least), F.lit(False))


def all_of(parsed: Column, path: str, test, least: int = 1) -> Column:
    """An array of ``least`` elements or more that all pass a test of VARIANTs."""
    found = F.try_variant_get(parsed, path, "array<variant>")
    return F.coalesce((F.size(found) >= least) & F.forall(found, lambda x: test(x)), F.lit(False))


def first_broken(rules: list[tuple[Column, str]]) -> Column:
    """Name of the first rule that does not hold, null where all do; a rule that is null does not hold."""
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for holds, name in rules])


def book_reason(parsed: Column) -> Column:
    """Why a book's entry is of no use: entry, id, type, the name of an empty field, auteurs, licence, sources, sha256, taille; null for a good one."""
    texts = [(is_text(parsed, f"$.{x}"), x) for x in BOOK_TEXTS]
    https = lambda x: is_text(x, "$", HTTPS)
    return first_broken(
        [
            (kind(parsed, "$").startswith("OBJECT"), "entry"),
            (is_text(parsed, "$.id", SLUG), "id"),
            (is_text(parsed, "$.type", "^pdf$"), "type"),
            *texts,
            (all_of(parsed, "$.auteurs", is_text), "auteurs"),
            (is_text(parsed, "$.licence.nom") & is_text(parsed, "$.licence.url", HTTPS), "licence"),
            (all_of(parsed, "$.sources", https), "sources"),
            (is_text(parsed, "$.sha256", SHA256), "sha256"),
            (is_whole(parsed, "$.taille", 1), "taille"),
        ]
    )


def is_file(parsed: Column) -> Column:
    """A file of a language pack: an https address, a hash, a size."""
    return is_text(parsed, "$.url", "^https://") & is_text(parsed, "$.sha256", SHA256) & (is_whole(parsed, "$.taille", -(2**53)))


def language_reason(parsed: Column, splitters: Column) -> Column:
    """Why a language's entry is of no use: code, nom, decoupage (none of the array ``splitters``), modeles; null for a good one."""
    known = F.array_contains(splitters, F.try_variant_get(parsed, "$.decoupage", "string"))
    name = kind(parsed, "$.nom") == "STRING"
    return first_broken([(is_text(parsed, "$.code", CODE), "code"), (name, "nom"), (known, "decoupage"), (all_of(parsed, "$.modeles", is_file, 0), "modeles")])


def model_reason(parsed: Column) -> Column:
    """Why a model's entry is of no use: id, tag, taille (not above 0), vram_min_mo (not 0 or more); null for a good one."""
    number = lambda path: F.try_variant_get(parsed, path, "double")
    given = lambda path: F.coalesce(F.length(F.try_variant_get(parsed, path, "string")) > 0, F.lit(False))
    return first_broken([(given("$.id"), "id"), (given("$.tag"), "tag"), (number("$.taille") > 0, "taille"), (number("$.vram_min_mo") >= 0, "vram_min_mo")])


def settings(parsed: Column, default: dict) -> Column:
    """struct(nom, avatar, couleur, configure, tutoiement, ton, longueur): each field where it is of use, else from ``default``; whatever is no
    JSON is as an empty object."""
    told = lambda path, most, name: F.coalesce(text_field(parsed, path, most), F.lit(default[name]))
    shaped = lambda path, shape, name: F.when(is_text(parsed, path, shape), F.try_variant_get(parsed, path, "string")).otherwise(F.lit(default[name]))
    flag = lambda path: F.when(kind(parsed, path) == "BOOLEAN", F.try_variant_get(parsed, path, "boolean"))
    return F.struct(
        told("$.nom", 40, "nom").alias("nom"),
        shaped("$.avatar", AVATAR, "avatar").alias("avatar"),
        F.lower(shaped("$.couleur", COLOUR, "couleur")).alias("couleur"),
        F.coalesce(flag("$.configure"), F.lit(False)).alias("configure"),
        F.coalesce(flag("$.personnalite.tutoiement"), F.lit(default["tutoiement"])).alias("tutoiement"),
        told("$.personnalite.ton", 200, "ton").alias("ton"),
        shaped("$.personnalite.longueur", f"^({'|'.join(LENGTHS)})$", "longueur").alias("longueur"),
    )
