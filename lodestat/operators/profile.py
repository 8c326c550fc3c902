"""Profiles of tables and columns, each in as few aggregates as possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lodestat.functions.columns import (
    Columns, is_missing, numeric_columns, pick, present, rows_from, text_columns,
    time_columns, type_of,
)
from lodestat.plans.distinct import distinct_counts
from lodestat.plans.quantiles import quantiles

WORD_BREAK = r"(?U)\s+"


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"),
    )


def missing_report(df: DataFrame, columns: Columns = None) -> DataFrame:
    """(column, missing_count, missing_percent); blank text is not missing here."""
    names = pick(df, columns, df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)],
    )
    return rows_from(counts, [
        F.struct(
            F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"),
            (F.try_divide(F.col(f"m{i}"), F.col("rows")) * 100).alias("missing_percent"),
        ) for i, c in enumerate(names)
    ])


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat another row: rows minus distinct rows."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_lodestat_n")).select("_lodestat_n")
    return groups.agg(F.coalesce(F.sum(F.col("_lodestat_n") - 1), F.lit(0)).alias("duplicates"))


# Bytes of a value by type.
TYPE_WIDTHS = {
    "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
    "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def size_estimate(df: DataFrame) -> DataFrame:
    """(column, bytes): text by its length, fixed types by their width."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        width = TYPE_WIDTHS.get(f.dataType.simpleString())
        if width is not None:
            size = F.count(F.lit(1)) * F.lit(width)
        else:
            text = F.col(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(f.name)
            size = F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))
        aggs.append(size.cast("long").alias(f"b{i}"))
    return rows_from(df.agg(*aggs), [
        F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("bytes"))
        for i, c in enumerate(df.columns)
    ])


def unique_counts(df: DataFrame, columns: Columns = None, approximate: bool = False) -> DataFrame:
    """(column, unique_count) of values present."""
    names = pick(df, columns, df.columns)
    if not approximate:
        found = distinct_counts(df, {c: present(df, c) for c in names})[1]
        return df.sparkSession.createDataFrame(list(found.items()), "column string, unique_count bigint")
    counts = df.agg(*[F.approx_count_distinct(present(df, c)).alias(f"u{i}") for i, c in enumerate(names)])
    return rows_from(counts, [
        F.struct(F.lit(c).alias("column"), F.col(f"u{i}").alias("unique_count"))
        for i, c in enumerate(names)
    ])


def value_ranges(df: DataFrame) -> DataFrame:
    """(column, min, max) as doubles; NULL for columns that hold no numbers."""
    numeric = set(numeric_columns(df))
    exprs = {c: present(df, c).cast("double") if c in numeric else F.lit(None).cast("double") for c in df.columns}
    ranges = df.agg(*[
        a for i, e in enumerate(exprs.values()) for a in (F.min(e).alias(f"lo{i}"), F.max(e).alias(f"hi{i}"))
    ])
    return rows_from(ranges, [
        F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(exprs)
    ])


def _kinds(df: DataFrame) -> DataFrame:
    kinds = [(f.name, f.dataType.simpleString(), isinstance(f.dataType, T.StringType)) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(kinds, "column string, type string, categorical boolean")


def overall_report(df: DataFrame) -> DataFrame:
    """Everything known per column: type, missing, unique, range and size."""
    report = F.broadcast(_kinds(df))  # one row per column of the table
    for part in (missing_report(df), unique_counts(df), value_ranges(df), size_estimate(df)):
        report = report.join(F.broadcast(part), "column")  # one row per column
    return report


def load_summary(df: DataFrame) -> DataFrame:
    """What is known right after loading: (column, type, kind, rows, missing)."""
    numeric, text = set(numeric_columns(df)), set(text_columns(df))
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    return rows_from(counts, [
        F.struct(
            F.lit(c).alias("column"), F.lit(type_of(df, c).simpleString()).alias("type"),
            F.lit("numeric" if c in numeric else "text" if c in text else "other").alias("kind"),
            F.col("rows"), F.col(f"m{i}").alias("missing"),
        ) for i, c in enumerate(df.columns)
    ])


def adjusted_skewness(n: Column, g1: Column, spread: Column) -> Column:
    """Sample skewness from the population one; NULL below 3 values."""
    value = g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(n > 2, F.when(spread == 0, F.lit(0.0)).otherwise(value))


def adjusted_kurtosis(n: Column, g2: Column, spread: Column) -> Column:
    """Sample excess kurtosis from the population one; NULL below 4 values."""
    below = F.when(n > 3, (n - 2) * (n - 3))
    value = (n - 1) / below * ((n + 1) * g2 + 6)
    return F.when(n > 3, F.when(spread == 0, F.lit(0.0)).otherwise(value))


def numeric_profile(df: DataFrame, columns: Columns = None) -> DataFrame:
    """One row per column: count, mean, std, min, q25, median, q75, max, adjusted
    skewness and kurtosis, and values beyond 1.5 IQR of the quartiles.

    Columns without values have no row. One pass for the quartiles and a second
    for all moments and the outlier counts.
    """
    names = pick(df, columns, numeric_columns(df))
    exprs = {c: present(df, c).cast("double") for c in names}
    found, _ = quantiles(df, exprs, [0.25, 0.5, 0.75])
    names = [c for c in names if found[c]]
    if not names:
        return df.sparkSession.createDataFrame([], NUMERIC_PROFILE)
    aggs, structs = [], []
    for i, c in enumerate(names):
        e, (q1, q2, q3) = exprs[c], found[c]
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        aggs += [
            F.count(e).alias(f"n{i}"), F.avg(e).alias(f"mean{i}"), F.stddev_samp(e).alias(f"sd{i}"),
            F.min(e).alias(f"lo{i}"), F.max(e).alias(f"hi{i}"), F.skewness(e).alias(f"g1{i}"),
            F.kurtosis(e).alias(f"g2{i}"), F.count_if((e < low) | (e > high)).alias(f"out{i}"),
        ]
        n, spread = F.col(f"n{i}").cast("double"), F.col(f"hi{i}") - F.col(f"lo{i}")
        structs.append(F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"mean{i}").alias("mean"),
            F.col(f"sd{i}").alias("std"), F.col(f"lo{i}").alias("min"), F.lit(q1).alias("q25"),
            F.lit(q2).alias("median"), F.lit(q3).alias("q75"), F.col(f"hi{i}").alias("max"),
            adjusted_skewness(n, F.col(f"g1{i}"), spread).alias("skewness"),
            adjusted_kurtosis(n, F.col(f"g2{i}"), spread).alias("kurtosis"),
            F.col(f"out{i}").alias("outliers"),
        ))
    return rows_from(df.agg(*aggs), structs)


NUMERIC_PROFILE = (
    "column string, count bigint, mean double, std double, min double, q25 double, median double, "
    "q75 double, max double, skewness double, kurtosis double, outliers bigint"
)


def _value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, n) of the values present, as text."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("value")) for c in names
    ]))
    long = df.select(pairs.alias("p")).select("p.*").where("value is not null")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_profile(df: DataFrame, columns: Columns = None) -> DataFrame:
    """(column, unique_count, entropy, most_common, most_common_count).

    Entropy in bits, by log2(N) - sum(n log2 n) / N. Ties go to the smaller value.
    """
    counts = _value_counts(df, pick(df, columns, text_columns(df)))
    n = F.col("n")
    total = F.sum(n)
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"),
        (F.log2(total) - F.sum(n * F.log2(n)) / total).alias("entropy"),
        F.min_by("value", F.struct(-n, F.col("value"))).alias("most_common"),
        F.max(n).alias("most_common_count"),
    )


def top_values(df: DataFrame, columns: Columns = None, n: int = 10) -> DataFrame:
    """(column, position, value, count): the most frequent values per column."""
    counts = _value_counts(df, pick(df, columns, text_columns(df)))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
        .select("column", "position", "value", F.col("n").alias("count"))
    )


def _moment(df: DataFrame, name: str) -> Column:
    if name in time_columns(df):
        return F.col(name).cast("timestamp_ntz")
    return F.try_to_timestamp(F.col(name)).cast("timestamp_ntz")


def _seconds(name: str) -> Column:
    """Whole seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name}) div 1000000")


def datetime_profile(df: DataFrame, columns: Columns = None) -> DataFrame:
    """(column, min_date, max_date, range_seconds, count); bad text is left out."""
    names = pick(df, columns, time_columns(df))
    aggs = [
        a for i, c in enumerate(names) for a in (
            F.min(_moment(df, c)).alias(f"lo{i}"), F.max(_moment(df, c)).alias(f"hi{i}"),
            F.count(_moment(df, c)).alias(f"n{i}"),
        )
    ]
    return rows_from(df.agg(*aggs), [
        F.struct(
            F.lit(c).alias("column"), F.col(f"lo{i}").alias("min_date"), F.col(f"hi{i}").alias("max_date"),
            (_seconds(f"hi{i}") - _seconds(f"lo{i}")).alias("range_seconds"),
            F.col(f"n{i}").alias("count"),
        ) for i, c in enumerate(names)
    ]).where("count > 0")


def weekday_counts(df: DataFrame, columns: Columns = None) -> DataFrame:
    """(column, weekday, count) by English weekday name."""
    names = pick(df, columns, time_columns(df))
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.date_format(_moment(df, c), "EEEE").alias("weekday"))
        for c in names
    ]))
    long = df.select(pairs.alias("p")).select("p.*").where("weekday is not null")
    return long.groupBy("column", "weekday").agg(F.count(F.lit(1)).alias("count"))


def _word_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, word, n)."""
    def words(c: str) -> Column:
        return F.array_remove(F.split(F.col(c).cast("string"), WORD_BREAK), "")

    if len(names) == 1:
        found = df.select(F.lit(names[0]).alias("column"), F.explode(words(names[0])).alias("word"))
    else:
        lists = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), words(c).alias("words")) for c in names]))
        found = df.select(lists).select("column", F.explode("words").alias("word"))
    return found.groupBy("column", "word").agg(F.count(F.lit(1)).alias("n"))


def text_profile(df: DataFrame, columns: Columns = None) -> DataFrame:
    """(column, count, mean_length, max_length, min_length, unique_words)."""
    names = pick(df, columns, text_columns(df))
    size = {c: F.length(F.col(c).cast("string")) for c in names}
    lengths = rows_from(
        df.agg(*[
            a for i, c in enumerate(names) for a in (
                F.count(c).alias(f"n{i}"), F.avg(size[c]).alias(f"mean{i}"),
                F.max(size[c]).alias(f"hi{i}"), F.min(size[c]).alias(f"lo{i}"),
            )
        ]),
        [F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"mean{i}").alias("mean_length"),
            F.col(f"hi{i}").alias("max_length"), F.col(f"lo{i}").alias("min_length"),
        ) for i, c in enumerate(names)],
    ).where("count > 0")
    words = _word_counts(df, names).groupBy("column").agg(F.count(F.lit(1)).alias("unique_words"))
    joined = lengths.join(F.broadcast(words), "column", "left")  # one row per column
    return joined.withColumn("unique_words", F.coalesce("unique_words", F.lit(0)))


def top_words(df: DataFrame, columns: Columns = None, n: int = 10) -> DataFrame:
    """(column, position, word, count): the most frequent words per column."""
    counts = _word_counts(df, pick(df, columns, text_columns(df)))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "word")
    return (
        counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
        .select("column", "position", "word", F.col("n").alias("count"))
    )


def _counts(df: DataFrame, names: list[str]) -> tuple[int, dict[str, tuple[int, int]]]:
    """(rows, {column: (missing, distinct values present)})."""
    row, found = distinct_counts(
        df, {c: present(df, c) for c in names}, F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)])
    return row["rows"], {c: (row[f"m{i}"], found[c]) for i, c in enumerate(names)}


def column_kinds(df: DataFrame, counts: tuple[int, dict[str, tuple[int, int]]] | None = None) -> dict[str, str]:
    """numeric, datetime, categorical or text, per column.

    Columns that are neither numbers nor times are categorical when they hold
    fewer than 1000 distinct values and fewer than 30 % of the row count. The
    distinct count is exact; booleans count as categorical.
    """
    numeric, times = set(numeric_columns(df)), set(time_columns(df))
    rows, found = counts or _counts(df, [c for c in df.columns if c not in numeric and c not in times])
    kinds = {}
    for c in df.columns:
        if c in numeric:
            kinds[c] = "numeric"
        elif c in times:
            kinds[c] = "datetime"
        else:
            few = found[c][1] < 0.3 * rows and found[c][1] < 1000
            kinds[c] = "categorical" if few else "text"
    return kinds


def _long(df: DataFrame, kind: str, label: str | None = None, skip=("column",)) -> DataFrame:
    """(column, kind, metric, number, text) rows from one row per column."""
    cells = []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        is_number = isinstance(f.dataType, T.NumericType)
        name = F.lit(f.name) if label is None else F.concat(F.lit(label + ": "), F.col(label).cast("string"))
        cells.append(F.struct(
            name.alias("metric"),
            (F.col(f.name).cast("double") if is_number else F.lit(None).cast("double")).alias("number"),
            (F.lit(None).cast("string") if is_number else F.col(f.name).cast("string")).alias("text"),
        ))
    return df.select("column", F.lit(kind).alias("kind"), F.inline(F.array(*cells)))


def full_profile(df: DataFrame) -> DataFrame:
    """The profile of every column by its kind: (column, kind, metric, number, text)."""
    counts = _counts(df, df.columns)
    kinds = column_kinds(df, counts)
    of = {k: [c for c in df.columns if kinds[c] == k] for k in ("numeric", "datetime", "categorical", "text")}
    rows, found = counts
    overall = df.sparkSession.createDataFrame(
        [(c, missing, missing / rows * 100 if rows else None, distinct) for c, (missing, distinct) in found.items()],
        "column string, missing_count long, missing_percent double, unique_count long")
    parts = [_long(overall, "overall")]
    if of["numeric"]:
        parts.append(_long(numeric_profile(df, of["numeric"]), "numeric"))
    if of["datetime"]:
        parts.append(_long(datetime_profile(df, of["datetime"]), "datetime"))
        parts.append(_long(weekday_counts(df, of["datetime"]), "datetime", "weekday", ("column", "weekday")))
    if of["categorical"]:
        parts.append(_long(categorical_profile(df, of["categorical"]), "categorical"))
        parts.append(_long(top_values(df, of["categorical"]), "categorical", "value", ("column", "value", "position")))
    if of["text"]:
        parts.append(_long(text_profile(df, of["text"]), "text"))
        parts.append(_long(top_words(df, of["text"]), "text", "word", ("column", "word", "position")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
