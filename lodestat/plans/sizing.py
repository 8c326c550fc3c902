"""One cheap pass that decides how a column may be processed.

The pass yields a row count and, per column, the approximate number of distinct
values and rank-balanced bucket edges. All results are bounded in size whatever
the table holds, so they may live on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# A table of distinct values up to this size may be held by one task or sent
# to every executor (two longs and a double each: about 10 MB).
SMALL_DISTINCT = 200_000
# An exact `percentile` keeps one map entry per distinct value it sees.
PERCENTILE_ROWS = 200_000
# A table of keys sent to every executor holds at most so many bytes of keys.
BROADCAST_BYTES = 64 << 20
# Distinct values aimed at per bucket.
BUCKET_VALUES = 250_000
_EDGES = 1_024
_MANY_EDGES = 16_384


def double_array(values) -> Column:
    """A literal array, parsed once instead of built element by element."""
    return F.expr("array(" + ",".join(f"{float(v)!r}D" for v in values) + ")")


def fits_broadcast(keys: int, widest: int = 8) -> bool:
    """Whether a table of so many keys, none wider than so many bytes, may go to every executor."""
    return keys <= SMALL_DISTINCT and keys * max(8, widest) <= BROADCAST_BYTES


def text_sizes(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, tuple[int, int]]:
    """(approximate distinct values, bytes of the widest one) per expression, one aggregate for all."""
    if not columns:
        return {}
    aggs = [
        a for i, c in enumerate(columns.values())
        for a in (F.approx_count_distinct(c).alias(f"d{i}"), F.max(F.octet_length(c.cast("string"))).alias(f"w{i}"))]
    row = df.agg(*aggs).first()
    return {n: (row[f"d{i}"], row[f"w{i}"] or 0) for i, n in enumerate(columns)}


@dataclass(frozen=True)
class ColumnSize:
    rows: int          # rows of the table
    present: int       # rows with a value
    distinct: int      # approximate
    edges: list[float]  # rank-balanced, repeated where one value spans several

    @property
    def small(self) -> bool:
        return self.distinct <= SMALL_DISTINCT

    @property
    def splits(self) -> list[float]:
        return bucket_splits(self.edges, self.distinct)


def count_sizes(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, int]:
    """Approximate distinct values per expression, one aggregate for all."""
    if not columns:
        return {}
    row = df.agg(*[F.approx_count_distinct(c).alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def column_sizes(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, ColumnSize]:
    """Row count, distinct estimate and bucket edges of numeric expressions."""
    names = list(columns)
    sizes = _measure(df, columns, _EDGES, 10_000)
    huge = [n for n in names if sizes[n].distinct > BUCKET_VALUES * _EDGES]
    if huge:
        sizes |= _measure(df, {n: columns[n] for n in huge}, _MANY_EDGES, 200_000)
    return sizes


def _measure(df, columns, edges, accuracy) -> dict[str, ColumnSize]:
    shares = double_array(np.linspace(0, 1, edges + 1)[1:-1])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, col in enumerate(columns.values()):
        aggs += [
            F.count(col).alias(f"n{i}"),
            F.approx_count_distinct(col).alias(f"d{i}"),
            F.percentile_approx(col.cast("double"), shares, accuracy).alias(f"e{i}"),
        ]
    row = df.agg(*aggs).first()
    return {
        name: ColumnSize(
            row["rows"], row[f"n{i}"], row[f"d{i}"], row[f"e{i}"] or [],
        )
        for i, name in enumerate(columns)
    }


def bucket_splits(edges: list[float], distinct: int, at_least: int = 8) -> list[float]:
    """Strictly increasing bucket borders taken from rank-balanced edges.

    An edge that repeats marks a value holding more than a whole bucket; the
    next double is added as a border so that such a value is alone in its bucket.
    """
    wanted = max(at_least, -(-distinct // BUCKET_VALUES))
    step = max(1, len(edges) // wanted)
    values, repeats = np.unique(np.asarray(edges, dtype=float), return_counts=True)
    hot = values[repeats > 1]
    borders = np.unique(np.concatenate([edges[step - 1::step], hot, np.nextafter(hot, np.inf)]))
    borders = borders[np.isfinite(borders)]
    return [-np.inf, *borders.tolist(), np.inf]
