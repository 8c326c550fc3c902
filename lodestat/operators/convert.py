"""Type conversion and encoding. The new schema depends on the data, so every
function runs one small statistics job and then returns a lazy projection."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lodestat.functions.columns import Columns, numeric_columns, pick, text_columns
from lodestat.plans.distinct import distinct_counts
from lodestat.plans.lineage import checkpoint
from lodestat.plans.sizing import fits_broadcast, text_sizes
from lodestat.plans.skew import join_values

# What counts as a number in text.
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

# Layouts tried when no date format is given.
DATE_LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd HH:mm:ss XXX",
    "yyyy-MM-dd", "yyyy/M/d HH:mm:ss", "yyyy/M/d", "M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm",
    "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy", "d/M/yyyy", "d.M.yyyy HH:mm:ss", "d.M.yyyy",
    "d-M-yyyy", "yyyyMMdd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy",
    "d MMM yyyy HH:mm:ss", "MMM d yyyy", "yyyy-M-d",
)

# Strptime directives and their datetime pattern letters.
STRPTIME_LETTERS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh",
    "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%j": "DDD", "%b": "MMM",
    "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%z": "xx", "%%": "'%'",
}


def to_numeric(df: DataFrame, columns: Columns = None, errors: str = "ignore") -> DataFrame:
    """Turn text columns into numbers, each column all or nothing.

    Whole numbers without gaps become long, anything else double; with gaps too
    if a double would lose digits. A column with a bad value, or a whole number
    that no long holds, stays as it is, or raises ValueError with errors='raise'.
    """
    names = [c for c in pick(df, columns, text_columns(df)) if c in text_columns(df)]
    if not names:
        return df
    row = df.agg(*[
        agg for i, c in enumerate(names) for agg in (
            F.count_if(F.when(F.col(c).rlike(INTEGER_TEXT), F.col(c).try_cast("long").isNull()).otherwise(
                ~F.col(c).rlike(NUMBER_TEXT) & (F.col(c) != ""))).alias(f"bad{i}"),
            F.count_if(~F.coalesce(F.col(c).rlike(INTEGER_TEXT), F.lit(False))).alias(f"real{i}"),
            F.count_if(~F.coalesce(F.col(c).rlike(INTEGER_TEXT), F.col(c).isNull() | (F.col(c) == ""))).alias(f"fraction{i}"),
            F.count_if(F.abs(F.col(c).try_cast("decimal(38,0)")) > 2**53).alias(f"long{i}"),
        )
    ]).first()
    out = {}
    for i, c in enumerate(names):
        if row[f"bad{i}"]:
            if errors == "raise":
                raise ValueError(f"Column '{c}' cannot be converted to numbers.")
            continue
        whole = not row[f"real{i}"] or (row[f"long{i}"] and not row[f"fraction{i}"])
        out[c] = F.col(c).try_cast("long" if whole else "double")
    return df.withColumns(out)


def spark_pattern(fmt: str) -> str:
    """The datetime pattern for a strptime format."""
    out, literal, i = [], [], 0

    def flush():
        if literal:
            out.append("'" + "".join(literal).replace("'", "''") + "'")
            literal.clear()

    while i < len(fmt):
        if fmt[i] == "%":
            letters = STRPTIME_LETTERS.get(fmt[i:i + 2])
            if letters is None:
                raise ValueError(f"Unsupported format directive '{fmt[i:i + 2]}'.")
            flush()
            out.append(letters)
            i += 2
        else:
            literal.append(fmt[i])
            i += 1
    flush()
    return "".join(out)


_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _could_be(layout: str, widths: bool = True) -> str:
    """A pattern that every text the layout parses matches, with or without the number of digits.

    A parse that fails raises an error inside, which costs far more than a pattern.
    """
    out = []
    for quoted, letters, other in re.findall(r"'([^']*)'|([A-Za-z]+)|([^A-Za-z'])", layout):
        if not letters:
            out.append(re.escape(quoted or other))
            continue
        for run in re.findall(r"MMMM|MMM|a|X+|(?:(?!MMM|[aX])[A-Za-z])+", letters):
            if run == "MMMM":
                out.append(f"({'|'.join(_MONTHS)})")
            elif run == "MMM":
                out.append(f"({'|'.join(m[:3] for m in _MONTHS)})t?[.]?")
            elif run == "a":
                out.append("[ap][.]?m[.]?")
            elif run[0] == "X":
                out.append("(z|[+-][0-9:]+)")
            elif not widths or len(run) == 1 or run[0] == "S":
                out.append("[+-]?[0-9]+")
            else:
                out.append("[0-9]{2}" if len(run) == 2 else f"[+-]?[0-9]{{{len(run)},}}")
    return r"(?i)^\s*" + "".join(out) + r"\s*$"


def _infer_layout(df: DataFrame, name: str, order_by: Columns) -> str | None:
    """The first layout that parses the first value present; without an order
    the one that parses most values, the first of equal ones."""
    col = F.col(name)
    parsed = [F.when(col.rlike(_could_be(p)), F.try_to_timestamp(col, F.lit(p))) for p in DATE_LAYOUTS]
    if order_by is None:
        # whether a text matches does not depend on its digits, so few distinct forms are tried; no layout fits longer ones
        forms = df.where(F.length(col) <= 256).select(F.regexp_replace(col, "[0-9]+", "0").alias("form")).distinct()
        fit = forms.agg(*[F.coalesce(F.bool_or(F.col("form").rlike(_could_be(p, widths=False))), F.lit(False)).alias(f"p{i}") for i, p in enumerate(DATE_LAYOUTS)]).first()
        if not any(fit):
            return None
        found = [0] * len(DATE_LAYOUTS)
        places = [i for i, some in enumerate(fit) if some]
        for i, n in zip(places, df.agg(*[F.count(parsed[i]).alias(f"p{i}") for i in places]).first()):
            found[i] = n
    else:
        key = F.struct(*pick(df, order_by, []))
        first = df.where(col.isNotNull()).agg(F.min_by(col, key).alias(name))
        found = list(first.select(*[x.isNotNull().cast("int").alias(f"p{i}") for i, x in enumerate(parsed)]).first())
    return DATE_LAYOUTS[found.index(max(found))] if max(found) else None


def to_datetime(
    df: DataFrame, columns: Columns = None, fmt: str | None = None, order_by: Columns = None,
) -> DataFrame:
    """Parse text as timestamps without zone; what does not parse becomes NULL.

    Without `fmt` (strptime style) the layout is taken from the first value in
    the order of `order_by`, or else is the one that parses most values. A
    column that no layout fits stays as it is. Times with an offset are set to
    the session's zone.
    """
    out = {}
    for c in pick(df, columns, text_columns(df)):
        layout = spark_pattern(fmt) if fmt else _infer_layout(df, c, order_by)
        if layout:
            parsed = F.try_to_timestamp(F.col(c), F.lit(layout))
            out[c] = (parsed if fmt else F.when(F.col(c).rlike(_could_be(layout)), parsed)).cast("timestamp_ntz")
    return df.withColumns(out)


def categories(df: DataFrame, column: str, limit: int | None = None) -> list:
    """Sorted distinct values of a column; ValueError above a `limit`."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    values = [r[0] for r in (distinct if limit is None else distinct.limit(limit + 1)).collect()]
    if limit is not None and len(values) > limit:
        raise ValueError(
            f"Column '{column}' has more than {limit} categories; use one_hot_vector instead."
        )
    return sorted(values)


def one_hot(df: DataFrame, columns: Columns = None, max_width: int | None = None) -> DataFrame:
    """Replace each column by boolean columns `column_value`, the first sorted
    category left out; NULL is False everywhere. The table gets a column per
    category, whose names the driver holds: `one_hot_vector` is the form for wide
    columns, and `max_width` makes more categories an error."""
    names = pick(df, columns, text_columns(df))
    flags = [
        F.coalesce(F.col(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}")
        for c in names for v in categories(df, c, max_width)[1:]
    ]
    return df.select(*[c for c in df.columns if c not in names], *flags)


def one_hot_vector(df: DataFrame, columns: Columns = None) -> DataFrame:
    """One sparse vector `column_vector` per column, for any number of categories."""
    names = pick(df, columns, text_columns(df))
    index = StringIndexer(
        inputCols=names, outputCols=[f"_{c}_index" for c in names],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    )
    encode = OneHotEncoder(
        inputCols=[f"_{c}_index" for c in names], outputCols=[f"{c}_vector" for c in names],
        dropLast=True,
    )
    encoded = Pipeline(stages=[index, encode]).fit(df).transform(df)
    return encoded.drop(*[f"_{c}_index" for c in names])


def label_codes(df: DataFrame, column: str, small: bool) -> DataFrame:
    """(column, _code, _n, _total): 0-based code of each distinct value in sorted order.

    Many values are sorted in ranges that Spark cuts by sampling them, whatever
    their common prefix; the ranges' sizes, a few rows, give the offsets.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    if small:
        order = Window.orderBy(column)  # a small table by its measured size
        coded = counts.withColumn("_code", F.row_number().over(order) - 1)
        return coded.select(column, F.col("_code").cast("long").alias("_code"), "_n", F.lit(0).alias("_total"))
    # the id holds the range above bit 33 and the place inside it below; written, so that both stay
    ranged = checkpoint(counts.orderBy(column).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_id", 33))
    ranges = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_held"), F.sum("_n").alias("_rows"))
    all_ = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        "_range", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(all_).alias("_total"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per range
    return ranged.join(F.broadcast(offsets), "_range").select(column, (F.col("_before") + place).alias("_code"), "_n", "_total")


def label_encode(df: DataFrame, columns: Columns = None) -> DataFrame:
    """Replace values by their 0-based place in sorted order; missing comes last."""
    names = pick(df, columns, text_columns(df))
    sizes = text_sizes(df, {c: F.col(c) for c in names})
    for c in names:
        small = fits_broadcast(*sizes[c])
        codes = label_codes(df, c, small)
        last = F.lit(codes.count()).cast("long")
        ordered = [F.coalesce("_code", last).alias(c) if x == c else F.col(x) for x in df.columns]
        if small:
            df = df.join(F.broadcast(codes.select(c, "_code")), c, "left").select(*ordered)  # size checked
            continue
        known = join_values(df.where(F.col(c).isNotNull()), codes, c, sizes[c][0], "_n", "_total", sizes[c][1])
        missing = df.where(F.col(c).isNull()).withColumn("_code", F.lit(None).cast("long"))
        df = known.select(*ordered).unionByName(missing.select(*ordered))
        if c != names[-1]:
            df = checkpoint(df)  # the next column reads the rows more than once
    return df


_INTEGER_RANGES = (("smallint", 2**15), ("int", 2**31))


def narrowing_plan(df: DataFrame) -> list[tuple[str, str, str, bool]]:
    """(column, type, narrower type, categorical) per column."""
    longs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType)]
    texts = text_columns(df)
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [agg(c).alias(f"{kind}_{c}") for c in longs for kind, agg in (("lo", F.min), ("hi", F.max))]
    row, distinct = distinct_counts(df, {c: F.col(c) for c in texts}, *aggs)
    plan = []
    for f in df.schema.fields:
        kind, categorical = f.dataType.simpleString(), False
        new = kind
        if isinstance(f.dataType, T.DoubleType):
            new = "float"
        elif f.name in longs and row[f"lo_{f.name}"] is not None:
            lo, hi = row[f"lo_{f.name}"], row[f"hi_{f.name}"]
            new = next((t for t, top in _INTEGER_RANGES if -top <= lo and hi < top), kind)
        elif f.name in texts and row["rows"]:
            categorical = distinct[f.name] / row["rows"] < 0.5
        plan.append((f.name, kind, new, categorical))
    return plan


def narrow_types(df: DataFrame) -> DataFrame:
    """double to float, long to the smallest integer type that holds its range,
    and text with few distinct values marked categorical in the column metadata."""
    return df.select(*[
        F.col(name).cast(new).alias(name, metadata={"categorical": True}) if categorical
        else F.col(name).cast(new).alias(name) if new != kind else F.col(name)
        for name, kind, new, categorical in narrowing_plan(df)
    ])
