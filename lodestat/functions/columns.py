"""Column selection by type and the missing-value policy."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

Columns = str | Sequence[str] | None

# White space as Python's str.strip sees it, Unicode blanks included.
BLANK_TEXT = r"(?U)^\s*$"


def require(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """The columns as a list; ValueError for the first one the table lacks."""
    columns = list(columns)
    for name in columns:
        if name not in df.columns:
            raise ValueError(f"Column '{name}' not found.")
    return columns


def _of_type(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    """All number columns. Booleans are not numbers here."""
    return _of_type(df, T.NumericType)


def text_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.StringType)


def time_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.DateType, T.TimestampType, T.TimestampNTZType)


def pick(df: DataFrame, columns: Columns, default: Sequence[str]) -> list[str]:
    """Named columns (checked), or the default when none are named."""
    if columns is None:
        return list(default)
    return require(df, [columns] if isinstance(columns, str) else columns)


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_fractional(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), (T.FloatType, T.DoubleType))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so aggregates skip it."""
    col = F.col(name)
    return F.when(~F.isnan(col), col) if is_fractional(df, name) else col


def is_missing(df: DataFrame, name: str) -> Column:
    col = F.col(name)
    return col.isNull() | F.isnan(col) if is_fractional(df, name) else col.isNull()


def number(df: DataFrame, name: str) -> Column:
    """The column as a double, times as microseconds since the epoch."""
    kind = type_of(df, name)
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("double") * 86_400e6
    if isinstance(kind, T.TimestampNTZType):  # no session zone may shift it
        quoted = name.replace("`", "``")
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{quoted}`)").cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name)).cast("double")
    if isinstance(kind, T.NumericType):
        return present(df, name).cast("double")
    raise ValueError(f"Column '{name}' is neither a number nor a time.")


def rows_from(one_row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn structs of one wide aggregate row into rows."""
    return one_row.select(F.inline(F.array(*structs)))
