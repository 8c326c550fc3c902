"""Helpers for writing registry entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# The test tables hold no NULLs; both sides of a check inject the same ones.
GAPPY_QUANTITY = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END"
GAPPY_PRICE = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END"
GAPPY_TEXT = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN ' ' ELSE text END"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6, **own: int) -> DataFrame:
    """Round double columns; `own` gives places by column name."""
    return df.select(*[
        F.round(f.name, own.get(f.name, places)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])
