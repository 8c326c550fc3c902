"""The small tables that charts are drawn from."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from lodestat.functions.columns import present, require, rows_from
from lodestat.operators import validate as checks
from lodestat.operators.edit import sort_by
from lodestat.plans.quantiles import quantiles, quantiles_by
from lodestat.plans.ranks import value_ranks
from lodestat.plans.skew import join_values

_ROOT_TWO_PI = 2.5066282746310002


def _value(df: DataFrame, name: str) -> Column:
    return present(df, require(df, [name])[0]).cast("double")


def _bin(value: Column, low, high, bins: int) -> Column:
    """Equal-width bin number; the last bin is closed, a single value is bin 0."""
    width = high - low
    place = F.floor(F.try_divide(value - low, width) * bins)
    return F.least(F.coalesce(place, F.when(value.isNotNull(), 0)), F.lit(bins - 1)).cast("int")


def _range(df: DataFrame, *exprs: Column) -> list[tuple[float, float]]:
    row = df.agg(*[a for i, e in enumerate(exprs) for a in (F.min(e).alias(f"lo{i}"), F.max(e).alias(f"hi{i}"))]).first()
    return [(row[f"lo{i}"], row[f"hi{i}"]) for i in range(len(exprs))]


def histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """(bin, lower, upper, count) for every bin, empty ones included."""
    value = _value(df, x)
    (low, high), = _range(df, value)
    schema = "bin int, lower double, upper double, count bigint"
    if low is None:
        return df.sparkSession.createDataFrame([], schema)
    counts = (
        df.where(value.isNotNull()).groupBy(_bin(value, F.lit(low), F.lit(high), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    step = (high - low) / bins
    edges = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), (F.lit(low) + F.col("id") * F.lit(step)).alias("lower"),
        (F.lit(low) + (F.col("id") + 1) * F.lit(step)).alias("upper"))
    # one row per bin on both sides
    return edges.join(F.broadcast(counts), "bin", "left").fillna(0, "count")


def bandwidth(n: Column, sd: Column, iqr: Column) -> Column:
    """Silverman's rule; the deviation alone where the quartiles coincide."""
    spread = F.when(iqr > 0, F.least(sd, iqr / 1.34)).otherwise(sd)
    return F.when(spread > 0, 0.9 * spread * F.pow(n.cast("double"), F.lit(-0.2)))


def kde(df: DataFrame, x: str, points: int = 50) -> DataFrame:
    """(point, x, density): Gaussian kernel density on an even grid from min to max.

    One aggregate holds a sum per grid point, combined inside every task.
    """
    value = _value(df, x)
    found, stats = quantiles(df, {"x": value}, [0.25, 0.75], extra=[
        F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi")])
    schema = "point int, x double, density double"
    if not found["x"] or not stats["sd"]:
        return df.sparkSession.createDataFrame([], schema)
    iqr = found["x"][1] - found["x"][0]
    spread = min(stats["sd"], iqr / 1.34) if iqr > 0 else stats["sd"]
    h = 0.9 * spread * stats["n"] ** -0.2
    step = (stats["hi"] - stats["lo"]) / (points - 1)
    grid = [stats["lo"] + i * step for i in range(points)]
    sums = df.select(value.alias("v")).where("v is not null").agg(*[_kernel_sum(F.lit(x), F.lit(h)).alias(f"s{i}") for i, x in enumerate(grid)])
    whole = F.lit(stats["n"] * h * _ROOT_TWO_PI)
    return rows_from(sums, [
        F.struct(F.lit(i).alias("point"), F.lit(x).alias("x"), (F.col(f"s{i}") / whole).alias("density")) for i, x in enumerate(grid)])


def _kernel_sum(x: Column, h: Column) -> Column:
    z = (x - F.col("v")) / h
    return F.sum(F.exp(z * z * -0.5))


def distribution(df: DataFrame, x: str) -> DataFrame:
    """(x, share): for every distinct value the share of rows at or below it."""
    ranks = value_ranks(df, _value(df, x))
    return ranks.select(
        F.col("value").alias("x"), ((F.col("before") + F.col("n")) / F.col("total")).alias("share"))


def _points(df: DataFrame, columns: list[str], key: str | None, max_points: int | None) -> DataFrame:
    if max_points is None:
        return df.select(*require(df, columns))
    if key is None:
        raise ValueError("A thinned chart needs the key that identifies the points.")
    # the points with the smallest hashes: each task keeps max_points at most
    order = [F.xxhash64(key), F.col(key)]
    return df.orderBy(*order).limit(max_points).select(*require(df, columns))


def scatter(df: DataFrame, x: str, y: str, key: str | None = None, max_points: int | None = None) -> DataFrame:
    """All points, or a repeatable even sample of `max_points` of them."""
    return _points(df, [x, y], key, max_points)


def scatter_3d(df: DataFrame, x: str, y: str, z: str, key: str | None = None, max_points: int | None = None) -> DataFrame:
    return _points(df, [x, y, z], key, max_points)


def line(df: DataFrame, x: str, y: str, buckets: int | None = None) -> DataFrame:
    """All points ordered by x, or (bucket, x, first, last, low, high, count) per
    equal-width stretch of x, which keeps every peak visible."""
    require(df, [x, y])
    if buckets is None:
        return sort_by(df.select(x, y), [x])
    px, py = _value(df, x), _value(df, y)
    (low, high), = _range(df, px)
    order = F.struct(px, py)
    return (
        df.where(px.isNotNull() & py.isNotNull())
        .groupBy(_bin(px, F.lit(low), F.lit(high), buckets).alias("bucket"))
        .agg(F.min(px).alias("x"), F.min_by(py, order).alias("first"), F.max_by(py, order).alias("last"),
             F.min(py).alias("low"), F.max(py).alias("high"), F.count(F.lit(1)).alias("count"))
        .orderBy("bucket")
    )


def bar(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, height): bars with the same x stack up."""
    return df.groupBy(*require(df, [x])).agg(F.sum(_value(df, y)).alias("height"))


def area(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, height) ordered by x."""
    return sort_by(bar(df, x, y), [x])


def _group_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, n, sd, low, high, q1, median, q3) per group."""
    value = _value(df, y)
    rows = df.where(F.col(x).isNotNull() & value.isNotNull())
    q = quantiles_by(rows, value, [0.25, 0.5, 0.75], [x])
    moments = rows.groupBy(x).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))
    return moments.join(q, x).select(
        "*", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")).drop("q")


def _with_group_stats(df: DataFrame, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """Values of each group joined with the statistics of their group.

    Small statistics, and those of hot groups, are broadcast, so no group is
    gathered in one task; what follows is summed inside every task.
    """
    value = _value(df, y)
    stats = _group_stats(df, x, y)
    seen = df.where(F.col(x).isNotNull() & value.isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(x, 0.02).alias("groups"),
        F.max(F.octet_length(F.col(x).cast("string"))).alias("widest")).first()
    values = df.where(F.col(x).isNotNull()).select(x, value.alias("v")).where("v is not null")
    sized = stats.withColumn("total", F.lit(seen["rows"]))
    return join_values(values, sized, x, seen["groups"], widest=seen["widest"] or 0).drop("total"), stats


def box(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, count, q1, median, q3, whisker_low, whisker_high, outliers) per group.

    Whiskers end at the last value within 1.5 IQR of the box.
    """
    joined, _ = _with_group_stats(df, x, y)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    return joined.groupBy(x).agg(
        F.count("v").alias("count"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def violin(df: DataFrame, x: str, y: str, points: int = 30) -> DataFrame:
    """(x, point, y, density): the density of every group on its own even grid."""
    joined, _ = _with_group_stats(df, x, y)
    h = bandwidth(F.col("n"), F.col("sd"), F.col("q3") - F.col("q1"))
    ready = joined.withColumn("h", h).where("h > 0").withColumn("step", (F.col("high") - F.col("low")) / (points - 1))
    sums = ready.groupBy(x).agg(
        F.first("low").alias("low"), F.first("step").alias("step"), (F.first("n") * F.first("h") * F.lit(_ROOT_TWO_PI)).alias("whole"),
        *[_kernel_sum(F.col("low") + i * F.col("step"), F.col("h")).alias(f"s{i}") for i in range(points)])
    at = F.posexplode(F.array(*[f"s{i}" for i in range(points)])).alias("point", "sum")
    return sums.select(F.col(x).alias(x), "low", "step", "whole", at).select(
        x, "point", (F.col("low") + F.col("point") * F.col("step")).alias("y"), (F.col("sum") / F.col("whole")).alias("density"))


def surface(df: DataFrame, x: str, y: str, z: str, x_bins: int = 10, y_bins: int = 10) -> DataFrame:
    """(row, col, z): mean z per cell of an even grid over x (rows) and y (columns)."""
    px, py, pz = (_value(df, c) for c in (x, y, z))
    (x0, x1), (y0, y1) = _range(df, px, py)
    return df.where(px.isNotNull() & py.isNotNull() & pz.isNotNull()).groupBy(
        _bin(px, F.lit(x0), F.lit(x1), x_bins).alias("row"), _bin(py, F.lit(y0), F.lit(y1), y_bins).alias("col"),
    ).agg(F.avg(pz).alias("z"))


def surface_matrix(cells: DataFrame, cols: int) -> DataFrame:
    """One row per grid row with columns c0, c1, ... from (row, col, z) cells."""
    wide = cells.groupBy("row").pivot("col", list(range(cols))).agg(F.first("z"))
    return wide.select("row", *[F.col(str(i)).alias(f"c{i}") for i in range(cols)])


def contour(
    df: DataFrame, x: str, y: str, z: str, levels: int = 8, x_bins: int = 10, y_bins: int = 10,
) -> DataFrame:
    """(row, col, z, level): the grid with the contour level of each cell."""
    cells = surface(df, x, y, z, x_bins, y_bins)
    (low, high), = _range(cells, F.col("z"))
    return cells.withColumn("level", _bin(F.col("z"), F.lit(low), F.lit(high), levels))


def heatmap(df: DataFrame, a: str, b: str, z: str) -> DataFrame:
    """(a, b, z): mean z per pair of categories."""
    return df.groupBy(*require(df, [a, b])).agg(F.avg(_value(df, z)).alias("z"))


_DRAWN = {
    "histogram": histogram, "kde": kde, "distribution": distribution, "scatter": scatter, "line": line,
    "bar": bar, "area": area, "box": box, "violin": violin, "scatter3d": scatter_3d, "surface": surface,
    "contour": contour, "heatmap": heatmap,
}


def chart_data(
    df: DataFrame, chart: str, x: str, y: str | None = None, z: str | None = None,
    order_by: str | None = None, checked: bool = True, **options,
) -> DataFrame:
    """The table behind a chart, after its columns have passed the checks.

    ValueError lists what is wrong with the columns. Grid charts take points, so
    the point check applies to them.
    """
    if chart not in _DRAWN:
        raise ValueError(f"Unknown chart type: {chart}")
    columns = [c for c in (x, y, z) if c is not None]
    if checked:
        kind = "scatter3d" if chart in checks.GRID else chart
        verdict = checks.validate(df, kind, *columns, order_by=order_by).first()
        if not verdict["is_valid"]:
            raise ValueError("Invalid data: " + "; ".join(verdict["errors"]))
    return _DRAWN[chart](df, *columns, **options)
