"""From raw documents to a training mix: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestat.llm import stages
from lodestat.llm.tables import read, store

STAGES = [
    ("quality rules", stages.passing_rules),
    ("near duplicates", stages.one_of_each),
    ("benchmark decontamination", stages.without_benchmarks),
    ("personal data", stages.without_personal_data),
    ("mixing", stages.mixed),
]
# Exact sampling by null-space moves and groups linked over several steps have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
