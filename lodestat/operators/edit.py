"""Filtering, sorting, paging and editing a table by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestat.functions.columns import Columns, pick, present, require, type_of
from lodestat.plans.lineage import checkpoint

_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "contains": lambda c, v: c.cast("string").contains(str(v)),
    "datestartswith": lambda c, v: F.date_format(c, "yyyy-MM-dd HH:mm:ss").startswith(str(v)),
}


def condition(df: DataFrame, column: str, operator: str, value) -> Column:
    require(df, [column])
    if operator not in _COMPARE:
        raise ValueError(f"Unknown filter operator '{operator}'.")
    return _COMPARE[operator](F.col(column), value)


def filter_columns(df: DataFrame, conditions: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Rows meeting every (column, operator, value) condition."""
    return df.where(reduce(and_, [condition(df, *c) for c in conditions])) if conditions else df


def sort_by(df: DataFrame, columns: Columns, ascending: bool | Sequence[bool] = True) -> DataFrame:
    """Sort by one or more columns, missing values last in both directions."""
    names = pick(df, columns, [])
    ways = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
    if len(ways) != len(names):
        raise ValueError("ascending must have one entry per column.")
    keys = []
    for name, up in zip(names, ways):
        col = present(df, name)  # a NaN is missing, so it sorts last too
        keys.append(col.asc_nulls_last() if up else col.desc_nulls_last())
    return df.orderBy(*keys)


def preview(df: DataFrame, order_by: Columns, n: int = 10) -> DataFrame:
    """The first n rows in the order of a key."""
    return sort_by(df, order_by).limit(n)


_NEAR_ROWS = 10_000  # a page that ends within so many rows comes from the first rows of every task
_PLACE, _RANGE_BITS = "_lodestat_place", 33


def page(df: DataFrame, order_by: Columns, number: int, size: int = 10) -> DataFrame:
    """Page `number` (from 0) of a table ordered by a key.

    For a page further in, the table is sorted in ranges and written; the sizes
    of the ranges tell where the page lies, and only its rows are looked at again.
    """
    first, stop = number * size, (number + 1) * size
    ordered = sort_by(df, order_by)
    if stop <= _NEAR_ROWS:
        return ordered.offset(first).limit(size)
    # the id holds the range in its upper bits and the place inside it below
    placed = checkpoint(ordered.withColumn(_PLACE, F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright(_PLACE, _RANGE_BITS).alias("range")).count().orderBy("range").collect()  # a row per range
    inside, before = F.lit(False), 0
    for r in ranges:
        low, high = max(first - before, 0), min(stop - before, r["count"])
        if low < high:
            start = r["range"] << _RANGE_BITS
            inside = inside | F.col(_PLACE).between(start + low, start + high - 1)
        before += r["count"]
    return sort_by(placed.where(inside).drop(_PLACE), order_by)


def delete_rows(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is not in `keys`; the columns of `keys` are the key."""
    return df.join(keys, require(df, keys.columns), "left_anti")


def select_rows(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is in `keys`."""
    return df.join(keys, require(df, keys.columns), "left_semi")


def delete_columns(df: DataFrame, columns: Columns) -> DataFrame:
    return df.drop(*pick(df, columns, []))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    require(df, names)
    return df.withColumnsRenamed(dict(names))


def select_columns(df: DataFrame, columns: Columns) -> DataFrame:
    return df.select(*pick(df, columns, []))


def apply_edits(df: DataFrame, edits: DataFrame, key: str, columns: Columns) -> DataFrame:
    """Replace single cells.

    `edits` has rows (key, column, value) with the value as text. A NULL value
    clears the cell. A value that does not fit the column's type leaves the
    cell, and so do edits of one cell that disagree; `bad_edits` lists both.
    """
    names = pick(df, columns, [])
    own = {c: F.when(F.col("column") == c, F.struct("value")) for c in names}
    wide = edits.groupBy(key).agg(*[
        F.when(F.min(e).eqNullSafe(F.max(e)), F.max(e)).alias(f"_edit_{c}") for c, e in own.items()
    ])
    joined = df.join(wide, key, "left")

    def edited(c: str) -> Column:
        edit = F.col(f"_edit_{c}")
        value = edit["value"].try_cast(type_of(df, c))
        return F.when(edit.isNotNull() & (edit["value"].isNull() | value.isNotNull()), value).otherwise(F.col(c))

    return joined.withColumns({c: edited(c) for c in names}).select(*df.columns)


def bad_edits(df: DataFrame, edits: DataFrame, columns: Columns) -> DataFrame:
    """The rows of `edits` that name no edited column, do not fit its type or contradict another edit of the cell."""
    cell = Window.partitionBy(*[c for c in edits.columns if c != "value"])
    agreed = F.min(F.struct("value")).over(cell).eqNullSafe(F.max(F.struct("value")).over(cell))
    fits = F.lit(False)
    for c in pick(df, columns, []):
        same = F.col("column") == c
        fits = fits | (same & (F.col("value").isNull() | F.col("value").try_cast(type_of(df, c)).isNotNull()))
    marked = edits.withColumn("_fits", F.coalesce(fits, F.lit(False)) & agreed)
    return marked.where(~F.col("_fits")).drop("_fits")
