"""Joins of a table with a per-value table, safe against hot values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestat.plans.sizing import fits_broadcast

# A value is hot when it holds more than this share of the rows, so there are
# fewer than 1 / HOT_SHARE of them and their table is always small.
HOT_SHARE = 0.001


def join_values(
    rows: DataFrame, table: DataFrame, key: str, distinct: int,
    n: str = "n", total: str = "total", widest: int = 8,
) -> DataFrame:
    """Inner join on `key`, where `table` has one row per key with its row count.

    `distinct` is the measured number of keys, `widest` the bytes of the widest
    one. A table small by both is broadcast whole.
    Otherwise rows of hot keys meet a broadcast of the hot part of the table
    (under 1 / HOT_SHARE rows) and only the cold rows are shuffled.
    """
    if fits_broadcast(distinct, widest):
        return rows.join(F.broadcast(table), key)
    hot = F.col(n) > F.col(total) * F.lit(HOT_SHARE)
    hot_table, cold_table = table.where(hot), table.where(~hot)
    hot_keys = F.broadcast(hot_table.select(key))
    warm = rows.join(F.broadcast(hot_table), key)
    cold = rows.join(hot_keys, key, "left_anti").join(cold_table, key)
    return warm.unionByName(cold)
