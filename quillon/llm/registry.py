"""The queries of the training-data operators, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import langid, lexical_search, license_scan, line_dedup, mixing, order_minhash, packing, quality_model, quality_rules, resampling, simhash, suffix_dedup, token_files
from quillon.llm.common import documents, stage, vocabulary
from quillon.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = langid.identify(docs, docs.where(~held_out).select("doc_id", "text", "lang"))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(documents(spark, sf_dir))
    return found.select("doc_id", "lines.n_lines", F.size("lines.removed").cast("long").alias("n_removed"), F.col("lines.removed").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    measured = stage(quality_rules.measure(docs).drop("text"), "measured")
    cuts = stage(quality_rules.cutoffs(measured, table(spark, sf_dir, "labels")), "cutoffs")
    return quality_rules.judge(measured, cuts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(mixing.sized(documents(spark, sf_dir)).select("doc_id", "source", "_size", "_u"), "sizes")
    found = stage(mixing.rates(rows), "rates").withColumnRenamed("source", "_source")
    return mixing.apply(rows, found).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    hashes = stage(suffix_dedup.known(docs), "known")
    found = suffix_dedup.spans(docs, hashes=hashes)
    partly = found.join(hashes.where("doc_id > first and n_bytes >= 50").select("doc_id").distinct(), "doc_id", "left_anti")
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    left = stage(suffix_dedup.kept(docs.join(partly, "doc_id")).select("doc_id", F.sha2("kept", 256).alias("left_sha")).dropDuplicates(["doc_id"]), "left")
    rows = hashes.join(found.select("doc_id", lost.alias("n"), F.size("spans").cast("long").alias("k")), "doc_id", "left").join(left, "doc_id", "left")
    sha = F.when(F.col("n") == F.col("n_bytes"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left_sha", "sha"))
    return rows.select("doc_id", "n_bytes", F.coalesce("n", F.lit(0)).alias("n_removed"), F.coalesce("k", F.lit(0)).alias("n_spans"), sha.alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), vocabulary())


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(documents(spark, sf_dir), vocabulary()))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = stage(quality_model.featured(documents(spark, sf_dir)), "features")
    model = quality_model.train(rows, table(spark, sf_dir, "labels").where(~held_out))
    found = quality_model.scored(rows, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours(documents(spark, sf_dir).select("doc_id", "text"))
    n = F.col("n_chars")
    half = F.floor(n / 2).cast("int")
    found = found.withColumn("edited", F.concat(F.left("text", (n - half).cast("int")), F.left("next_text", half))).drop("next_text")
    found = order_minhash.fingerprint(order_minhash.fingerprint(found, "text", "fp").drop("text"), "edited", "efp")
    found = found.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited").withColumn("nfp", F.lead("fp").over(in_order())).where("not guest")
    shown = order_minhash.written
    return found.select("doc_id", "n_chars", "edited_sha256", shown("fp").alias("fingerprint"), shown("efp").alias("edited_fingerprint"), order_minhash.likeness("fp", "efp").alias("near_edited"), order_minhash.likeness("fp", "nfp").alias("near_next"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), 50)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.importance(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), percent=5, least_words=20)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def in_order():
    """Order of documents within a block: descending, the next block's first document, a guest, at the end."""
    return Window.partitionBy("block").orderBy("guest", F.desc("key"), "text_key")


def neighbours(docs: DataFrame, blocks: int = 400) -> DataFrame:
    """Rows (block, guest, key, text_key, doc_id, text, n_chars, next_text): each document beside the next one in descending doc_id order.

    Bounds from quantiles of doc_id cut the order into at most ``blocks`` blocks; only their bounds and first ids pass the driver.
    The first document of each block also stands, as a guest, at the end of the block before it (the very first at the end of
    the last). Null ids come last; rows that repeat an id are in the order of their texts' hashes.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    bounds = docs.agg(F.percentile_approx("key", [k / blocks for k in range(1, blocks)], 10 * blocks)).first()[0] or []
    bounds = sorted(set(bounds))
    if not bounds:
        bounds = [0]
    docs = docs.withColumn("block", F.size(F.filter(F.lit(bounds), lambda x: x < F.col("key"))))
    heads = dict(docs.select("block", "key").groupBy("block").agg(F.max("key")).collect())
    order = sorted(heads, reverse=True)
    host = {b: order[k - 1] for k, b in enumerate(order)}  # the block before in descending order; of the first block, the last
    size = len(bounds) + 1
    head = F.lit([heads.get(b) if b in heads else 0 for b in range(size)] or [0])
    to = F.lit([host.get(b, 0) for b in range(size)] or [0])
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(to[F.col("block")].alias("block"), F.lit(True).alias("guest"))
    rows = docs.withColumn("places", F.when(head[F.col("block")] == F.col("key"), F.array(own, guest)).otherwise(F.array(own))).drop("block")
    rows = rows.select("doc_id", "text", "key", F.xxhash64("text").alias("text_key"), F.inline("places"))
    return rows.withColumn("next_text", F.lead("text").over(in_order())).withColumn("n_chars", F.length("text").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_simhash, op2_language_id, op3_line_dedup, op4_quality_rules, op5_mixing, op6_suffix_dedup, op7_packing, op8_token_files, op9_quality_model, op10_order_minhash, op11_lexical_search, op12_resampling, op13_license_scan]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_lexical_search": lexical_search.SQL, "op12_resampling": resampling.SQL, "op13_license_scan": license_scan.SQL}
