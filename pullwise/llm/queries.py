"""The operators' queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pullwise.llm import (collocations, fingerprints, hard_negatives, host_quality, jaccard, langid, license_scan, line_dedup, lm_score, mixing,
                          oracle, packing, pseudonyms, secret_scan)
from pullwise.llm.common import read

PSEUDONYM_KEY = "demonstration key"     # a deployment passes its own


def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(read(spark, sf_dir, "documents"))


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def lm_score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more like the benchmark's texts than like the corpus each document is."""
    return lm_score.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.place(packing.pieces(read(spark, sf_dir, "documents")))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents"))


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("found")).alias("spans"))


def pseudonyms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(jaccard.near_duplicates(read(spark, sf_dir, "documents")))


def host_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.judge(read(spark, sf_dir, "documents"))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def hard_negative_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.quantised(read(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def collocation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.licenses(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints_query,
    "op2_line_dedup": line_dedup_query,
    "op3_lm_score": lm_score_query,
    "op4_best_fit_packing": packing_query,
    "op5_source_mixing": mixing_query,
    "op6_secret_scan": secrets_query,
    "op7_jaccard_join": jaccard_query,
    "op8_pseudonyms": pseudonyms_query,
    "op9_host_quality": host_quality_query,
    "op10_language": language_query,
    "op11_hard_negatives": hard_negative_query,
    "op12_collocations": collocation_query,
    "op13_license_scan": license_query,
}

SQL: dict[str, str] = oracle.SQL
