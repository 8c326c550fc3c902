"""Exact ranks and cumulative counts without a global sort in one task.

A column is first collapsed to its distinct values with their counts (combined
on the map side, so a value holding a third of the rows costs one row per task).
The values are cut into rank-balanced buckets; a window counts inside a bucket
and the bucket totals, a few rows, give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestat.plans.sizing import ColumnSize, column_sizes

BUCKET = "_bucket"
_KEY = "_bucket_key"


def with_bucket(df: DataFrame, key: Column, splits: Sequence[float]) -> DataFrame:
    """Add the bucket number of a numeric key; equal keys share a bucket."""
    cutter = Bucketizer(splits=list(splits), inputCol=_KEY, outputCol=BUCKET, handleInvalid="keep")
    keyed = df.withColumn(_KEY, key.cast("double"))
    return cutter.transform(keyed).drop(_KEY).withColumn(BUCKET, F.col(BUCKET).cast("int"))


def running_totals(
    df: DataFrame, amounts: Sequence[str], order: Sequence[str], by: Sequence[str] = (),
) -> DataFrame:
    """Add `before_<a>` and `total_<a>` per amount: its sum over earlier rows and
    over all rows of the `by` group.

    The table must carry a bucket number that grows with `order`.
    """
    by = list(by)
    inside = Window.partitionBy(*by, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket: at most as many rows per group as there are edges
    group = Window.partitionBy(*by)
    earlier = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*by, BUCKET).agg(*[F.sum(a).alias(f"_held_{a}") for a in amounts]).select(
        *by, BUCKET,
        *[F.coalesce(F.sum(f"_held_{a}").over(earlier), F.lit(0)).alias(f"_offset_{a}") for a in amounts],
        *[F.sum(f"_held_{a}").over(group).alias(f"total_{a}") for a in amounts],
    )
    if not by:
        offsets = F.broadcast(offsets)  # bounded by the number of edges
    local = df.withColumns({f"_inside_{a}": F.coalesce(F.sum(a).over(inside), F.lit(0)) for a in amounts})
    joined = local.join(offsets, [*by, BUCKET]).withColumns({
        f"before_{a}": F.col(f"_inside_{a}") + F.col(f"_offset_{a}") for a in amounts})
    return joined.drop(BUCKET, *[f"_{k}_{a}" for k in ("inside", "offset") for a in amounts])


def running_total(
    df: DataFrame, amount: str, order: Sequence[str], by: Sequence[str] = (),
    before: str = "before", total: str = "total",
) -> DataFrame:
    """`running_totals` of one amount, under the given names."""
    return running_totals(df, [amount], order, by).withColumnsRenamed({
        f"before_{amount}": before, f"total_{amount}": total})


def value_ranks(
    df: DataFrame, value: Column, by: Sequence[str] = (), size: ColumnSize | None = None,
) -> DataFrame:
    """One row per group and distinct value: (by..., value, n, before, total).

    `n` rows hold the value, `before` rows of the group hold a smaller one and
    `total` rows hold any. NULLs are left out.
    """
    if size is None:
        size = column_sizes(df, {"v": value})["v"]
    counts = (
        df.select(*by, value.alias("value")).where(F.col("value").isNotNull())
        .groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    )
    if size.small:  # few values by measure: one window holds those of a group
        group = Window.partitionBy(*by)
        earlier = group.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(
            "*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(group).alias("total"))
    return running_total(with_bucket(counts, F.col("value"), size.splits), "n", ["value"], by)


def average_rank() -> Column:
    """1-based rank of a `value_ranks` row, ties averaged."""
    return F.col("before") + (F.col("n") + 1) / 2


def value_at(index: Column) -> Column:
    """Aggregate over `value_ranks` rows: the value at a 0-based sorted position."""
    held = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
    return F.max(F.when(held, F.col("value")))
