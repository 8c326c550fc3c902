"""Column scaling: one aggregate for the statistics, then a narrow projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lodestat.functions.columns import Columns, numeric_columns, pick, present
from lodestat.plans.quantiles import quantiles


def _columns(df: DataFrame, columns: Columns) -> dict[str, Column]:
    names = pick(df, columns, numeric_columns(df))
    return {c: present(df, c).cast("double") for c in names}


def _stats(df: DataFrame, exprs: dict[str, Column], **aggs) -> dict[str, dict]:
    if not exprs:
        return {}
    row = df.agg(*[
        agg(e).cast("double").alias(f"{kind}{i}")
        for i, e in enumerate(exprs.values()) for kind, agg in aggs.items()
    ]).first()
    return {c: {kind: row[f"{kind}{i}"] for kind in aggs} for i, c in enumerate(exprs)}


def _scaled(col: Column, shift: float | None, width: float | None) -> Column:
    """(col - shift) / width, NULL where the width is zero or unknown."""
    if shift is None or not width or math.isnan(width):
        return F.lit(None).cast("double")
    return (col - F.lit(shift)) / F.lit(width)


def min_max(df: DataFrame, columns: Columns = None, feature_range: tuple = (0, 1)) -> DataFrame:
    """Map [min, max] onto `feature_range`; a constant column becomes NULL."""
    low, high = feature_range
    exprs = _columns(df, columns)
    stats = _stats(df, exprs, lo=F.min, hi=F.max)
    return df.withColumns({
        c: _scaled(e, s["lo"], None if s["lo"] is None else s["hi"] - s["lo"])
        * F.lit(float(high - low)) + F.lit(float(low))
        for (c, e), s in zip(exprs.items(), stats.values())
    })


def z_score(df: DataFrame, columns: Columns = None) -> DataFrame:
    """(x - mean) / sample standard deviation."""
    exprs = _columns(df, columns)
    stats = _stats(df, exprs, mean=F.avg, sd=F.stddev_samp)
    return df.withColumns({c: _scaled(e, stats[c]["mean"], stats[c]["sd"]) for c, e in exprs.items()})


def max_abs(df: DataFrame, columns: Columns = None) -> DataFrame:
    """x / max(|x|)."""
    exprs = _columns(df, columns)
    stats = _stats(df, exprs, top=lambda e: F.max(F.abs(e)))
    return df.withColumns({c: _scaled(e, 0.0, stats[c]["top"]) for c, e in exprs.items()})


def robust(df: DataFrame, columns: Columns = None) -> DataFrame:
    """(x - median) / IQR. With IQR 0, values off the median become +-infinity."""
    exprs = _columns(df, columns)
    found, _ = quantiles(df, exprs, [0.25, 0.5, 0.75])
    out = {}
    for c, e in exprs.items():
        if found[c] is None:
            out[c] = F.lit(None).cast("double")
            continue
        q1, median, q3 = found[c]
        if q3 > q1:
            out[c] = _scaled(e, median, q3 - q1)
        else:
            out[c] = (F.when(e > median, F.lit(math.inf))
                      .when(e < median, F.lit(-math.inf)))
    return df.withColumns(out)


def log1p(df: DataFrame, columns: Columns = None) -> DataFrame:
    """log(1 + x); -1 becomes -infinity, anything below is missing."""
    return df.withColumns({
        c: F.when(e > -1, F.log1p(e)).when(e == -1, F.lit(-math.inf))
        for c, e in _columns(df, columns).items()
    })


_METHODS = {"min_max": min_max, "zscore": z_score, "max_abs": max_abs, "robust": robust, "log": log1p}


def normalize_data(df: DataFrame, method: str = "zscore", columns: Columns = None, **options) -> DataFrame:
    """Scale by the name of the method: min_max, zscore, max_abs, robust or log."""
    if method not in _METHODS:
        raise ValueError(f"Method '{method}' not supported.")
    return _METHODS[method](df, columns, **options)
