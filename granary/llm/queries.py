"""The queries opN_<name> over the synthetic tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import align, decontam, langid, licenses, linededup, lmscore, neardup, negatives, packing, pieces, quality, tokencount, warc
from granary.llm.oracles import SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return langid.identify(docs, langid.profiles(docs.where(~held_out)), [F.col("doc_id"), held_out.alias("held_out")])


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=2048)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: each takes its place in a tree by its number. One in ten is named LICENSE,
    and of these one in ten, and one in a hundred, stands one and two directories higher."""
    n = F.col("doc_id")
    up = F.when(n % 1000 == 0, 1).when(n % 100 == 0, 2).otherwise(3)
    parts = F.slice(F.array(*[F.floor(n / d).cast("string") for d in (1000, 100, 10)]), 1, up)
    name = F.when(n % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    docs = _table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", F.lit("tree"), parts, name))
    return licenses.scan(docs, keep=["doc_id"])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.summary(_table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1")
    return lmscore.score(_table(spark, sf_dir, "documents"), good)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record is read back at the place that the index gives for it."""
    bundles, index = warc.write(_table(spark, sf_dir, "pages"))
    return warc.lookup(bundles, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(_table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
        op1_language_id,
        op2_best_fit_packing,
        op3_benchmark_decontamination,
        op4_license_scan,
        op5_quality_rules,
        op6_line_dedup,
        op7_lm_scoring,
        op8_minhash_near_dedup,
        op9_warc_bundles,
        op10_token_counts,
        op11_cross_tokenizer_alignment,
        op12_sentencepiece,
        op13_hard_negatives,
    )}
__all__ = ["QUERIES", "SQL"]
