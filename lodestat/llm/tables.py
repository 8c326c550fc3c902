"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestat.plans.lineage import checkpoint_folder


def store(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    Cuts lineage like a checkpoint, but keeps columns apart, so later steps read
    only those they name, and gives the optimizer a true size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bins(rows: int, per_bin: int) -> int:
    """How many groups to deal `rows` into, each of about `per_bin`."""
    return max(1, -(-rows // per_bin))
