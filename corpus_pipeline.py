"""From raw documents to packed training sequences: five stages, each a table that the next one reads.

What the stages do with unusual rows: a null text counts as an empty one and fails the quality rules, so it goes in the first stage;
given to the near-copies stage, texts without a word are copies of each other. An empty table gives an empty table. Ties go to the
smaller doc_id; rows that repeat a doc_id stay or go together as near copies. Columns that documents do not have are kept by all
stages but the last. Texts are read whole, however long. A null source is one source of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import line_dedup, mixing, packing, quality_rules, simhash
from quillon.llm.common import stage, vocabulary
from quillon.session import ship, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship(spark)
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that come again, or nearly, go from the later place; n_chars, where there is such a column, follows the text."""
    ship(spark)
    found = line_dedup.cleaned(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: candidates by SimHash, verified on five-word shingles at a similarity of 0.8 or more."""
    ship(spark)
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the weights 5, 2, 1: documents are left out or repeated."""
    ship(spark)
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048."""
    ship(spark)
    return packing.packed(docs, vocabulary())


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash", near_copies), ("mixing", mixture), ("packing", sequences)]
#: Tokenizing is not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
