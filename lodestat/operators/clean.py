"""Missing values and duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from lodestat.functions.columns import (
    BLANK_TEXT, Columns, is_fractional, is_missing, numeric_columns, pick, present, text_columns,
)
from lodestat.plans.quantiles import quantiles

FILL_METHODS = ("mean", "median", "min", "max", "mode", "constant")


def missing_mask(df: DataFrame, name: str, only_null: bool = False) -> Column:
    """True where the value is null, NaN or (unless `only_null`) white space only."""
    mask = is_missing(df, name)
    if not only_null and name in text_columns(df):
        mask = mask | F.col(name).rlike(BLANK_TEXT)
    return mask


def find_missing(
    df: DataFrame, columns: Columns = None, only_null: bool = False, keep: Sequence[str] = (),
) -> DataFrame:
    """One boolean column per checked column, next to the `keep` columns."""
    names = pick(df, columns, [c for c in df.columns if c not in keep])
    return df.select(*keep, *[missing_mask(df, c, only_null).alias(c) for c in names])


def drop_missing(df: DataFrame, columns: Columns = None, only_null: bool = False) -> DataFrame:
    """Drop rows in which any checked column is missing."""
    names = pick(df, columns, df.columns)
    return df.where(~reduce(or_, [missing_mask(df, c, only_null) for c in names]))


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict:
    """Most frequent value per column, the smallest on ties, NULL when empty."""
    modes = {}
    for name in columns:
        counts = df.select(present(df, name).alias("v")).where("v is not null").groupBy("v").count()
        best = F.min_by("v", F.struct(-F.col("count"), F.col("v")))
        modes[name] = counts.agg(best.alias("v")).first()["v"]
    return modes


def fill_values(df: DataFrame, columns: Sequence[str], method: str, value=None) -> dict:
    """The value each numeric column would be filled with."""
    if method not in FILL_METHODS:
        raise ValueError(f"Unknown fill method '{method}'. Known: {', '.join(FILL_METHODS)}.")
    if method == "constant":
        if value is None:
            raise ValueError("Method 'constant' needs a value.")
        return dict.fromkeys(columns, value)
    if not columns:
        return {}
    exprs = {c: present(df, c) for c in columns}
    if method == "median":
        found, _ = quantiles(df, exprs, [0.5])
        return {c: q[0] if q else None for c, q in found.items()}
    if method == "mode":
        return column_modes(df, columns)
    agg = {"mean": F.avg, "min": F.min, "max": F.max}[method]
    return df.agg(*[agg(e).alias(c) for c, e in exprs.items()]).first().asDict()


def fill_missing(df: DataFrame, columns: Columns = None, method: str = "mean", value=None) -> DataFrame:
    """Fill missing numbers; columns of other types are left as they are."""
    numeric = set(numeric_columns(df))
    names = [c for c in pick(df, columns, df.columns) if c in numeric]
    fills = {c: v for c, v in fill_values(df, names, method, value).items() if v is not None}
    # an integer column without gaps keeps its type whatever the fill value
    whole = [c for c, v in fills.items() if isinstance(v, float) and not is_fractional(df, c)]
    if whole:
        gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in whole]).first()
        fills = {c: v for c, v in fills.items() if c not in whole or gaps[c]}
    return df.withColumns({c: F.coalesce(present(df, c), F.lit(v)) for c, v in fills.items()})


def _kept_keys(df: DataFrame, order_by: list[str], columns: list[str], keep) -> DataFrame:
    """Keys of the rows that are not flagged as duplicates.

    Only a count and one key per distinct value are aggregated, combined on the
    map side, so a value repeated in a third of the rows is no hot group.
    """
    if keep not in ("first", "last", False):
        raise ValueError("keep must be 'first', 'last' or False.")
    single = len(order_by) == 1
    key = F.col(order_by[0]) if single else F.struct(*order_by)
    pickup = (F.max if keep == "last" else F.min)(key).alias("_key")
    groups = df.groupBy(*columns).agg(pickup, F.count(F.lit(1)).alias("_n"))
    if keep is False:
        groups = groups.where("_n = 1")
    if single:
        return groups.select(F.col("_key").alias(order_by[0]))
    return groups.select("_key.*")


def _duplicate_args(df, order_by, columns):
    order_by = pick(df, order_by, [])
    if not order_by:
        raise ValueError("order_by must name the key that orders and identifies the rows.")
    return order_by, pick(df, columns, [c for c in df.columns if c not in order_by])


def _by_key(df: DataFrame, keys: DataFrame, order_by: list[str], how: str) -> DataFrame:
    """Join on the key, NULL matching NULL."""
    named = keys.select(*[F.col(c).alias(f"_kept_{i}") for i, c in enumerate(order_by)])
    same = [df[c].eqNullSafe(F.col(f"_kept_{i}")) for i, c in enumerate(order_by)]
    return df.join(named, reduce(lambda a, b: a & b, same), how)


def find_duplicates(df: DataFrame, order_by: Columns, columns: Columns = None, keep="first") -> DataFrame:
    """Rows flagged as duplicates of an earlier (or later, or any) row.

    `order_by` stands for the row position: it must be unique. Without `columns`
    all other columns are compared. NULLs equal each other. A row without a key
    is neither the first nor the last of several, and is not flagged where it or
    another row without a key is kept.
    """
    order_by, columns = _duplicate_args(df, order_by, columns)
    return _by_key(df, _kept_keys(df, order_by, columns, keep), order_by, "left_anti")


def clean_duplicates(df: DataFrame, order_by: Columns, columns: Columns = None, keep="first") -> DataFrame:
    """The rows `find_duplicates` does not flag."""
    order_by, columns = _duplicate_args(df, order_by, columns)
    return _by_key(df, _kept_keys(df, order_by, columns, keep), order_by, "left_semi")
