"""Stages of the corpus pipeline: (spark, docs, sf_dir) to the documents that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestat.llm import decontamination, mixing, near_duplicates as near, personal_data, quality_rules as rules
from lodestat.llm.tables import read, store


def passing_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy, which holds the base rules."""
    return rules.passing(docs, rules.CURRENT)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest doc_id.

    Repeated rows of a document count as one. Where a doc_id has several texts,
    each stays or goes by its own set of shingles. Rows without doc_id stay.
    """
    found = store(near.near_duplicates(docs).select("doc_id", "kept", "set_key"))
    dropped = found.where("not kept").select("doc_id").distinct()
    counts = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    rest = docs.join(dropped, "doc_id", "left_anti")
    mixed_ids = found.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("kept").alias("all"), F.max("kept").alias("some")).where("some and not all").select("doc_id")
    if not mixed_ids.isEmpty():
        rest = rest.unionByName(_kept_texts(docs.join(mixed_ids, "doc_id", "left_semi"), found))
    if counts.isEmpty():
        return rest
    once = rest.join(counts, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(counts, "doc_id", "left_anti").unionByName(once).select(docs.columns)


def _kept_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows whose doc_id and set of shingles are kept; a text without shingles has no key."""
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("set_key").alias("_key")).distinct()
    texts = near.set_keys(docs.select("doc_id", "text").distinct())
    stay = texts.join(kept, (F.col("doc_id") == F.col("_id")) & F.col("set_key").eqNullSafe(F.col("_key")), "left_semi").select(
        F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    return docs.join(stay, (F.col("doc_id") == F.col("_id")) & F.col("text").eqNullSafe(F.col("_text")), "left_semi")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of `benchmark`: mostly such ones go, others lose the passages.

    NULL and empty texts, and rows without doc_id, stay; repeated rows are treated alike.
    """
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; NULL stays NULL."""
    return personal_data.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus that the mix takes: all columns with their texts, `copies` of each, and `size`, `target`, `taken`.

    NULL and empty texts have no words but may be taken; rows equal in all
    columns are one, with their copies added.
    """
    return mixing.mixed_corpus(docs)
