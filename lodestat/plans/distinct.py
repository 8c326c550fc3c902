"""Exact distinct counts of many columns.

Several exact counts in one aggregate make Spark copy every row once per column.
Here one aggregate estimates how many values each column has and how wide they
are. Columns whose values fit small sets are counted together in a second one;
each other column by a grouping of its own, which reads that column alone and
sends every distinct value at most once per task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row, functions as F

# Sets of one task hold about so many bytes of values, of all columns together.
SET_BYTES = 16 << 20
SET_VALUES = 10_000

_WIDE = ("string", "binary")
_PLAIN = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz", "string")


def distinct_counts(df: DataFrame, columns: Mapping[str, Column], *also: Column) -> tuple[Row, dict[str, int]]:
    """The row of the aggregates `also`, and {name: distinct values that are not NULL}.

    Zeros of either sign are one value; a column without values has 0.
    """
    kinds = {n: df.select(c).schema[0].dataType.simpleString() for n, c in columns.items()}
    aggs = list(also)
    for i, (n, c) in enumerate(columns.items()):
        aggs.append(F.approx_count_distinct(c).alias(f"_about{i}"))
        if kinds[n] in _WIDE:
            aggs.append(F.max(F.octet_length(c)).alias(f"_wide{i}"))
    if not aggs:
        return Row(), {}
    row = df.agg(*aggs).first()
    sized = []
    for i, n in enumerate(columns):
        width = max(8, row[f"_wide{i}"] or 0) if kinds[n] in _WIDE else 8
        if kinds[n] in _PLAIN and row[f"_about{i}"] <= SET_VALUES:
            sized.append((row[f"_about{i}"] * width, n))
    room, few = SET_BYTES, []
    for size, n in sorted(sized):
        if size <= room:
            room -= size
            few.append(n)
    found = {}
    if few:
        zero = {n: columns[n] + F.lit(0.0) if kinds[n] in ("float", "double") else columns[n] for n in few}
        sets = df.agg(*[F.size(F.collect_set(c)).alias(f"_set{i}") for i, c in enumerate(zero.values())]).first()
        found = {n: sets[i] for i, n in enumerate(few)}
    many = [n for n in columns if n not in found]
    if many:
        groups = [
            df.select(columns[n].alias("_value")).where("_value is not null").distinct()
            .agg(F.lit(i).alias("_column"), F.count(F.lit(1)).alias("_values")) for i, n in enumerate(many)]
        out = groups[0]
        for g in groups[1:]:
            out = out.unionByName(g)
        found |= {many[r["_column"]]: r["_values"] for r in out.collect()}  # a row per column
    return row, {n: found[n] for n in columns}
