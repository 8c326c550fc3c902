"""Checks of columns before they are charted. Each returns one row:
(is_valid, errors, and the counts behind them)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestat.functions.columns import number, require
from lodestat.plans.quantiles import quantiles
from lodestat.plans.ranks import BUCKET, with_bucket
from lodestat.plans.sizing import column_sizes

ONE_D = ("histogram", "kde", "distribution")
TWO_D = ("scatter", "line", "bar", "area", "box", "violin")
GRID = ("surface", "contour", "heatmap")
THREE_D = ("scatter3d", *GRID)
_INFINITY = float("inf")


def _as_number(df: DataFrame, name: str) -> Column:
    return F.col(name).try_cast("double")


def _bad_text(df: DataFrame, name: str) -> Column:
    """Count of values present that are no numbers."""
    return F.count_if(F.col(name).isNotNull() & _as_number(df, name).isNull())


def _nan(df: DataFrame, name: str) -> Column:
    return F.count_if(F.col(name).isNull() | F.isnan(_as_number(df, name)))


def _infinite(df: DataFrame, name: str) -> Column:
    return F.count_if(F.abs(_as_number(df, name)) == _INFINITY)


def _verdict(counts: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    errors = F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]), lambda e: e.isNotNull())
    return counts.select((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), "*")


def validate_1d(
    df: DataFrame, x: str, min_points: int = 2, max_outlier_percentage: float = 10,
) -> DataFrame:
    """Numbers only, enough of them, no NaN, no infinity, not too many outliers."""
    require(df, [x])
    value = _as_number(df, x)
    finite = F.when(~F.isnan(value), value)
    found, _ = quantiles(df, {"x": finite}, [0.25, 0.75])
    outside = F.lit(False)
    if found["x"]:
        q1, q3 = found["x"]
        outside = (finite < q1 - 1.5 * (q3 - q1)) | (finite > q3 + 1.5 * (q3 - q1))
    points = F.count(F.lit(1))
    counts = df.agg(
        points.alias("points"), _bad_text(df, x).alias("not_numeric"), _nan(df, x).alias("nan"),
        _infinite(df, x).alias("infinite"),
        F.coalesce(F.try_divide(F.count_if(outside), points) * 100, F.lit(0.0)).alias("outlier_percentage"),
    )
    return _verdict(counts, [
        (F.col("not_numeric") > 0, "data must be numeric"),
        (F.col("points") < min_points, f"too few points, at least {min_points} needed"),
        (F.col("nan") > 0, "NaN values present"),
        (F.col("infinite") > 0, "infinite values present"),
        (F.col("outlier_percentage") > max_outlier_percentage, "too many outliers"),
    ])


def _not_above(window, value: str = "x", earlier: str = "x") -> Column:
    above = F.coalesce(F.col(value) > F.lag(earlier).over(window), F.lit(False))
    return (F.row_number().over(window) > 1) & ~above


def order_breaks(df: DataFrame, x: str, order_by: str) -> DataFrame:
    """(breaks): rows whose x is not above the x of the row before them.

    Rows are cut into buckets of the order key. A window compares neighbours in
    a bucket; the first row of a bucket is compared with the last one of the
    bucket before it, over one row per bucket.
    """
    rows = df.select(_as_number(df, x).alias("x"), number(df, order_by).alias("k")).where("k is not null")
    size = column_sizes(rows, {"k": F.col("k")})["k"]
    cut = with_bucket(rows, F.col("k"), size.splits)
    inside = Window.partitionBy(BUCKET).orderBy("k")
    breaks = cut.select(_not_above(inside).alias("b"))
    ends = cut.groupBy(BUCKET).agg(F.min_by("x", "k").alias("first"), F.max_by("x", "k").alias("last"))
    order = Window.orderBy(BUCKET)  # one row per bucket, at most one per edge
    joints = ends.select(_not_above(order, "first", "last").alias("b"))
    return breaks.unionByName(joints).agg(F.count_if("b").alias("breaks"))


def _points(df: DataFrame, names: list[str]) -> list[Column]:
    total = lambda f: sum((f(df, c) for c in names[1:]), f(df, names[0]))
    lengths = [F.count(c).alias(f"count_{i}") for i, c in enumerate(names)]
    return [
        F.count(F.lit(1)).alias("points"), *lengths, total(_bad_text).alias("not_numeric"),
        total(_nan).alias("nan"), total(_infinite).alias("infinite"),
    ]


def _point_rules(names: list[str]) -> list[tuple[Column, str]]:
    unequal = F.lit(False)
    for i in range(1, len(names)):
        unequal = unequal | (F.col("count_0") != F.col(f"count_{i}"))
    return [
        (unequal, "columns must have equal length"),
        (F.col("not_numeric") > 0, "data must be numeric"),
        (F.col("nan") > 0, "NaN values present"),
        (F.col("infinite") > 0, "infinite values present"),
    ]


def validate_2d(
    df: DataFrame, x: str, y: str, chart: str = "scatter", order_by: str | None = None,
) -> DataFrame:
    """Equal lengths, numbers only, no NaN or infinity; for bar and line charts x
    must also grow strictly in the order of `order_by`."""
    names = require(df, [x, y])
    rules = _point_rules(names)
    if chart not in ("bar", "line"):
        return _verdict(df.agg(*_points(df, names)), rules)
    if order_by is None:
        raise ValueError(f"Chart '{chart}' needs order_by to check the order of x.")
    breaks = order_breaks(df, x, order_by).first()["breaks"]
    counts = df.agg(*_points(df, names)).withColumn("order_breaks", F.lit(breaks))
    return _verdict(counts, [*rules, (F.col("order_breaks") > 0, f"x must be ordered for {chart}")])


def validate_3d_points(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    names = require(df, [x, y, z])
    return _verdict(df.agg(*_points(df, names)), _point_rules(names))


def validate_3d_grid(df: DataFrame, row: str, col: str, z: str) -> DataFrame:
    """A grid given as cells: full rectangle of unique cells, numbers only, no NaN
    or infinity. Row and column numbers start at 0."""
    require(df, [row, col, z])
    cells = df.groupBy(row, col).agg(
        F.count(F.lit(1)).alias("n"), _bad_text(df, z).alias("bad"), _nan(df, z).alias("nan"),
        _infinite(df, z).alias("inf"),
    )
    counts = cells.agg(
        F.count(F.lit(1)).alias("cells"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"),
        F.coalesce((F.max(row) + 1) * (F.max(col) + 1), F.lit(0)).cast("long").alias("area"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("not_numeric"),
        F.coalesce(F.sum("nan"), F.lit(0)).alias("nan"),
        F.coalesce(F.sum("inf"), F.lit(0)).alias("infinite"),
    )
    return _verdict(counts, [
        ((F.col("cells") != F.col("area")) | (F.col("repeated") > 0), "a full two-dimensional grid is needed"),
        (F.col("not_numeric") > 0, "data must be numeric"),
        (F.col("nan") > 0, "NaN values present"),
        (F.col("infinite") > 0, "infinite values present"),
    ])


def validate(
    df: DataFrame, chart: str, x: str | None = None, y: str | None = None, z: str | None = None,
    order_by: str | None = None,
) -> DataFrame:
    """The check that belongs to a chart type, as (is_valid, errors). For grids x
    and y are the row and column numbers. A check that cannot run is not valid."""
    try:
        if chart in ONE_D:
            found = validate_1d(df, x)
        elif chart in TWO_D:
            found = validate_2d(df, x, y, chart, order_by)
        elif chart in GRID:
            found = validate_3d_grid(df, x, y, z)
        elif chart in THREE_D:
            found = validate_3d_points(df, x, y, z)
        else:
            raise ValueError(f"Unknown chart type: {chart}")
        return found.select("is_valid", "errors")
    except (ValueError, AnalysisException) as error:
        text = str(error)
        return df.sparkSession.createDataFrame(
            [(False, [text])], "is_valid boolean, errors array<string>")
