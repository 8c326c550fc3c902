"""The operators of this package as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestat.llm import (
    decontamination, license_scan, manifest, mixing, near_duplicates as near, personal_data, quality_classifier, quality_rules as rules,
    secret_scan, sql, token_counts, toxicity, url_filter, whitening,
)
from lodestat.llm.tables import read


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(read(spark, folder, "documents"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The label of a page is `quality` of the document with its number; the tables have no other link."""
    labels = read(spark, folder, "labels")
    outcomes = labels.select(labels["doc_id"].alias("page_id"), labels["quality"].alias("good"))
    return url_filter.judge(read(spark, folder, "pages"), outcomes).drop("low")


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.personal_data(read(spark, folder, "documents"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark")).drop("spans", "items")


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(read(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    base = rules.verdict(rules.BASE)
    return rules.ledger(read(spark, folder, "documents")).select(
        "doc_id", *[m for m in rules.MEASURES if m != "n_lines"], (~base).alias("base_failed"),
        (base & rules.verdict(rules.CURRENT)).alias("kept"), "failed")


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.license_scan(read(spark, folder, "documents"))
    said = F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["start"].cast("string"), m["stop"].cast("string"), m["matched"].cast("string")))
    return found.select(
        "doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.array_join(said, ",").alias("spans"),
        F.array_join(F.transform(F.filter("matches", lambda m: m["best"]), lambda m: m["template"]), ",").alias("best"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels")).drop("cosines")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.quality(read(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"))


def op12_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.secrets(read(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.said(F.col("base")), 256).alias("base_sha256"),
        secret_scan.said(F.col("found")).alias("spans"))


def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest(read(spark, folder, "documents"), manifest.lower_cased())


ENTRIES = {
    "op1_near_duplicates": (op1_near_duplicates, None),
    "op2_url_filter": (op2_url_filter, sql.URL_FILTER),
    "op3_personal_data": (op3_personal_data, None),
    "op4_decontamination": (op4_decontamination, sql.DECONTAMINATION),
    "op5_mixing": (op5_mixing, None),
    "op6_token_counts": (op6_token_counts, None),
    "op7_quality_rules": (op7_quality_rules, sql.QUALITY_RULES),
    "op8_license_scan": (op8_license_scan, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_quality_classifier": (op10_quality_classifier, None),
    "op11_whitening": (op11_whitening, None),
    "op12_secrets": (op12_secrets, sql.SECRETS),
    "op13_manifest": (op13_manifest, sql.MANIFEST),
}
