"""Spreading small inputs for jobs that read them many times."""

from __future__ import annotations

from pyspark.sql import DataFrame

_ROWS_PER_TASK = 10_000


def spread(df: DataFrame) -> DataFrame:
    """Rows over the cores, for iterative fitting.

    A small table comes in fewer splits than there are cores, often in one, or in
    many nearly empty ones after a join. It is counted and its rows are then
    redistributed once, to no more tasks than they are worth. A table with at
    least one full split per core is neither counted nor shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728").rstrip("bB"))
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate >= cores * split:
        return df
    return df.repartition(max(1, min(cores, df.count() // _ROWS_PER_TASK)))
