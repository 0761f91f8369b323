"""Published manifests as tables (manifests, their categories, their articles): the first fault of each, many manifests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.checks import HTTPS, SHA256, SLUG, first_broken

# The format that is read, the largest archive, lengths of a version and of an article's slug, how a date begins.
FORMAT, LARGEST, VERSION, LONGEST = 1, 100 * 1024 * 1024, 100, 150
DATE = "^\\d{4}-\\d{2}-\\d{2}"


def _marked(rows: DataFrame) -> DataFrame:
    """rows with ``again``: whether the slug stands before in its manifest."""
    first = rows.groupBy("manifest", "slug").agg(F.min("pos").alias("_first"))
    return rows.join(first, ["manifest", "slug"], "left").withColumn("again", F.coalesce(F.col("pos") > F.col("_first"), F.lit(False))).drop("_first")


def faults(manifests: DataFrame, categories: DataFrame, articles: DataFrame, published: bool = True) -> DataFrame:
    """(manifest, reason, item): the first fault of each manifest, null where there is none; item is the slug it is about.

    manifests (manifest, format, version, generated_at, origin, sha256, size, url), the last three of the archive, origin that of the
    manifest's own address; categories (manifest, pos, slug, title, description, place) and articles (manifest, pos, slug, title, summary,
    category, published, updated, sha256), pos being unique in its manifest. Order of the rules: the manifest's head, categories in order,
    articles in order, the archive. An archive's own manifest (``published`` false) must name no archive. A manifest without
    categories or articles has none to fault."""
    filled = lambda c: F.trim(F.col(c)) != ""
    head = first_broken([(F.col("format") == FORMAT, "format"), (filled("version") & (F.length("version") <= VERSION), "version"), (filled("generated_at"), "generated_at")])
    kinds = _marked(categories)
    bad = first_broken([(F.col("slug").rlike(SLUG) & filled("title") & F.col("description").isNotNull() & F.col("place").isNotNull() & ~F.isnan("place"), "category"), (~F.col("again"), "category again")])
    kinds = kinds.select("manifest", "pos", "slug", bad.alias("reason"))
    known = categories.select("manifest", F.col("slug").alias("category")).distinct().withColumn("_known", F.lit(True))
    own = _marked(articles).join(known, ["manifest", "category"], "left")
    bad = first_broken(
        [
            (F.col("slug").rlike(SLUG) & (F.length("slug") <= LONGEST), "article"),
            (~F.col("again"), "article again"),
            (filled("title") & F.col("summary").isNotNull(), "title"),
            (F.col("_known"), "unknown category"),
            (F.col("published").rlike(DATE) & F.col("updated").rlike(DATE), "dates"),
            (F.col("sha256").rlike(SHA256), "sha256"),
        ]
    )
    own = own.select("manifest", "pos", "slug", bad.alias("reason"))
    place = F.struct("part", "pos")
    rows = kinds.withColumn("part", F.lit(1)).unionByName(own.withColumn("part", F.lit(2))).where("reason is not null")
    first = rows.groupBy("manifest").agg(F.min_by(F.struct("reason", "slug"), place).alias("x"))
    if published:
        origin = F.lower(F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]+)", 1))
        tail = first_broken([(F.col("sha256").rlike(SHA256) & F.col("size").between(1, LARGEST), "archive"), (F.col("url").rlike(HTTPS) & (origin == F.col("origin")), "archive elsewhere")])
    else:
        tail = first_broken([(F.col("sha256").isNull() & F.col("size").isNull() & F.col("url").isNull(), "archive named")])
    told = manifests.select("manifest", head.alias("_head"), tail.alias("_tail")).join(first, "manifest", "left")
    return told.select("manifest", F.coalesce("_head", "x.reason", "_tail").alias("reason"), F.when(F.col("_head").isNull(), F.col("x.slug")).alias("item"))
