"""Anomalous rows by eight methods. Rows with a missing value are never flagged."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestat.functions.columns import Columns, numeric_columns, pick, present, require
from lodestat.operators.series import decompose
from lodestat.plans.layout import spread
from lodestat.plans.lineage import checkpoint
from lodestat.plans.neighbors import Tree, build_tree, coordinates, count_within, nearest, weighted_points
from lodestat.plans.quantiles import quantiles
from lodestat.plans.skew import HOT_SHARE
from lodestat.plans.sums import FourierFeatures, vector_sum


def _outside(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    if low is None or high is None or math.isnan(low) or math.isnan(high):
        return df.limit(0)
    col = F.col(column)
    # plain comparisons with literals reach the scan; a NaN compares as greatest
    return df.where(((col < F.lit(low)) | (col > F.lit(high))) & present(df, column).isNotNull())


def _moments(df: DataFrame, column: str, deviation) -> tuple[float | None, float | None]:
    value = present(df, require(df, [column])[0]).cast("double")
    row = df.agg(F.avg(value).alias("m"), deviation(value).alias("s")).first()
    return row["m"], row["s"]


def three_sigma(df: DataFrame, column: str) -> DataFrame:
    """Rows more than three sample standard deviations from the mean."""
    mean, sd = _moments(df, column, F.stddev_samp)
    if mean is None or sd is None:
        return df.limit(0)
    return _outside(df, column, mean - 3 * sd, mean + 3 * sd)


def iqr(df: DataFrame, column: str) -> DataFrame:
    """Rows beyond 1.5 interquartile ranges of the quartiles."""
    value = present(df, require(df, [column])[0]).cast("double")
    found, _ = quantiles(df, {column: value}, [0.25, 0.75])
    if found[column] is None:
        return df.limit(0)
    q1, q3 = found[column]
    return _outside(df, column, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))


def z_score(df: DataFrame, column: str, threshold: float = 3) -> DataFrame:
    """Rows with |x - mean| / population standard deviation above the threshold."""
    mean, sd = _moments(df, column, F.stddev_pop)
    if not sd:
        return df.limit(0)
    z = (present(df, column).cast("double") - F.lit(mean)) / F.lit(sd)
    return df.where(F.abs(z) > threshold)


# --- isolation forest ------------------------------------------------------

SAMPLE = 256  # rows a tree grows from, at most


def _path_correction(n: float) -> float:
    """Mean path length of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _tree_samples(df: DataFrame, columns: list[str], trees: int, seed: int, sample: int) -> DataFrame:
    """(tree, place, x): at most `sample` rows per tree, chosen by hash so that a rerun agrees.

    Rows at one point are counted first. A hash of the point and the tree turns
    the expected number of its rows in that tree into a whole number, so a row
    joins each tree on its own and a crowded point is in each by its weight. Only
    points that are drawn become rows.
    """
    points = df.select(coordinates(df, columns).alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    n = points.agg(F.sum("w")).first()[0] or 0
    share = 1.5 * sample / max(n, 1)

    def copies(tree: Column) -> Column:
        unit = F.pmod(F.xxhash64("x", tree, F.lit(seed)), F.lit(2**31)) / F.lit(float(2**31))
        return F.least(F.floor(F.col("w") * F.lit(share) + unit), F.col("w"))

    drawn = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), copies(t).alias("copies"))),
        lambda d: d["copies"] > 0)
    each = points.select("x", F.inline(drawn)).select("x", "tree", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    each = each.withColumn("h", F.xxhash64("x", "tree", "copy", F.lit(seed + 2)))
    order = Window.partitionBy("tree").orderBy("h", "x", "copy")  # about 1.5 * sample rows
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample).select("tree", "place", "x")


def _grow(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One isolation tree as parallel node arrays."""
    pdf = pdf.sort_values("place")
    x = np.stack(pdf["x"].to_numpy())
    rng = np.random.default_rng([seed, int(pdf["tree"].iloc[0])])
    limit = math.ceil(math.log2(max(2, len(x))))
    feature, cut, left, right, length = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(feature)
        for column in (feature, left, right):
            column.append(-1)
        cut.append(0.0)
        length.append(depth + _path_correction(len(rows)))
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(usable):
            f = int(rng.choice(usable))
            at = rng.uniform(low[f], high[f])
            feature[me], cut[me] = f, at
            goes_left = rows[:, f] <= at
            left[me] = node(rows[goes_left], depth + 1)
            right[me] = node(rows[~goes_left], depth + 1)
        return me

    node(x, 0)
    return pd.DataFrame({
        "feature": [feature], "cut": [cut], "left": [left], "right": [right], "length": [length], "n": [len(x)],
    })


def isolation_scores(
    df: DataFrame, columns: Sequence[str], trees: int = 100, seed: int = 42, sample: int = SAMPLE,
) -> Column:
    """The anomaly score of each row, 2 ** -(mean path / expected path).

    Trees grow in parallel from samples of at most `sample` rows. A forest is at
    most 2 * trees * sample nodes whatever the table, and travels with the
    scoring function.
    """
    samples = _tree_samples(df, list(columns), trees, seed, sample)
    grown = samples.groupBy("tree").applyInPandas(
        lambda pdf: _grow(pdf, seed),
        "feature array<int>, cut array<double>, left array<int>, right array<int>, length array<double>, n int",
    ).collect()
    forest = [tuple(np.asarray(r[c]) for c in ("feature", "cut", "left", "right", "length")) for r in grown]
    expected = _path_correction(max([r["n"] for r in grown], default=1)) or 1.0

    @F.pandas_udf("double")
    def score(points: pd.Series) -> pd.Series:
        out = np.full(len(points), np.nan)
        known = points.notna().to_numpy()
        if known.any() and forest:
            x = np.stack(points[known].to_numpy())
            rows, total = np.arange(len(x)), np.zeros(len(x))
            for feature, cut, left, right, length in forest:
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    goes_left = x[rows, np.maximum(f, 0)] <= cut[at]
                    at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
                total += length[at]
            out[known] = 2.0 ** (-total / len(forest) / expected)
        return pd.Series(out)

    return score(coordinates(df, columns))


def isolation_forest(
    df: DataFrame, columns: Columns, key: Columns = None, trees: int = 100, seed: int = 42, threshold: float = 0.5,
    sample: int = SAMPLE,
) -> DataFrame:
    """Rows that random splits isolate quickly (Liu et al. 2008): score above 0.5.

    Each tree grows from a sample of `sample` rows. The draw depends on the
    features alone; `key` is checked and otherwise of no effect.
    """
    names = pick(df, columns, numeric_columns(df))
    pick(df, key, [])
    score = isolation_scores(df, names, trees, seed, sample)
    return df.withColumn("_lodestat_score", score).where(
        (F.col("_lodestat_score") > threshold) & ~F.isnan("_lodestat_score")).drop("_lodestat_score")


# --- one-class SVM ---------------------------------------------------------


def one_class_svm(
    df: DataFrame, columns: Columns, nu: float = 0.5, gamma: float | None = None,
    features: int = 128, steps: int = 15, seed: int = 42,
) -> DataFrame:
    """Rows outside the region that holds the denser share 1 - nu of the rows.

    Approximate: the RBF kernel is replaced by random Fourier features and the
    linear one-class objective is minimized with one sum over the table per step.
    The offset is the exact nu-quantile of the scores.
    """
    names = pick(df, columns, numeric_columns(df))
    lift = FourierFeatures(len(names), gamma or 1.0 / len(names), features, seed)
    at = coordinates(df, names)
    # equal points have equal scores
    rows = spread(df.select(at.alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))).persist()
    bins = 1_024

    def step_sums(w: np.ndarray, rho: float, low: float, high: float):
        def terms(batch: pd.DataFrame) -> np.ndarray:
            z, n = lift(np.stack(batch["x"].to_numpy())), batch["n"].to_numpy(float)
            scores = z @ w
            below = scores <= rho
            place = np.clip((scores - low) / (high - low) * bins, 0, bins - 1).astype(int)
            return np.concatenate([[n[below].sum()], n[below] @ z[below], np.bincount(place, n, minlength=bins)])
        return terms

    try:
        w, rho, low, high = np.zeros(features), math.inf, -1.0, 1.0
        for t in range(1, steps + 1):
            total = vector_sum(rows, step_sums(w, rho, low, high), 1 + features + bins)
            if total[0] == 0:
                break
            w = (1 - 1 / t) * w + total[1:features + 1] / total[0] / t
            # the scores move little per step: the next offset comes from a
            # histogram around the current ones, scaled like w itself
            high = float(np.linalg.norm(w)) * math.sqrt(2.0)
            low = -high
            counts = vector_sum(rows, step_sums(w, -math.inf, low, high), 1 + features + bins)[1 + features:]
            passed = np.cumsum(counts) >= nu * counts.sum()
            rho = low + (int(np.argmax(passed)) + 1) * (high - low) / bins
    finally:
        rows.unpersist()

    @F.pandas_udf("double")
    def score(points: pd.Series) -> pd.Series:
        out = np.full(len(points), np.nan)
        known = points.notna().to_numpy()
        if known.any():
            out[known] = lift(np.stack(points[known].to_numpy())) @ w
        return pd.Series(out)

    scored = df.withColumn("_score", score(at))
    found, _ = quantiles(scored, {"s": F.when(~F.isnan("_score"), F.col("_score"))}, [nu])
    if found["s"] is None:
        return df.limit(0)
    return scored.where((F.col("_score") < F.lit(found["s"][0])) & ~F.isnan("_score")).drop("_score")


# --- neighbours ------------------------------------------------------------


def _rows_at(df: DataFrame, columns: list[str], places: DataFrame, tree: Tree, crowd: int) -> DataFrame:
    """Rows of the table at the given points (q).

    A point with `crowd` or more rows is never among them, so rows at hot points
    leave by a broadcast of these (under 1 / HOT_SHARE points) before the rest
    is shuffled.
    """
    rows = tree.points.agg(F.sum("w")).first()[0] or 0
    hot = tree.points.where(F.col("w") >= max(crowd, rows * HOT_SHARE)).select(F.col("at").alias("_at"))
    return (
        df.withColumn("_at", coordinates(df, columns))
        .join(F.broadcast(hot), "_at", "left_anti")
        .join(places.select(F.col("q").alias("_at")), "_at", "left_semi").drop("_at")
    )


def dbscan_noise(df: DataFrame, columns: Columns, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Rows that are neither core points nor within eps of one.

    A core point has at least `min_samples` rows within eps, itself included.
    """
    names = pick(df, columns, numeric_columns(df))
    tree = build_tree(weighted_points(df, names), len(names))
    counts = count_within(tree.points.select(F.col("at").alias("q")), tree, eps, min_samples)
    loose = checkpoint(counts.where(F.col("found") < min_samples).select("q"))
    core = tree.points.join(loose.select(F.col("q").alias("at")), "at", "left_anti")
    near_core = count_within(loose, build_tree(core, len(names), like=tree), eps, 1)
    return _rows_at(df, names, near_core.where("found = 0"), tree, min_samples)


def knn_distance(df: DataFrame, columns: Columns, n_neighbors: int = 5, threshold: float = 1.5) -> DataFrame:
    """Rows whose mean distance to their nearest rows exceeds the threshold.

    As in the usual fit-and-query on the same rows, a row is its own nearest
    neighbour at distance 0. With k rows within threshold * k / (k - 1) the mean
    cannot exceed the threshold, so only the other rows are searched in full.
    """
    names = pick(df, columns, numeric_columns(df))
    tree = build_tree(weighted_points(df, names), len(names))
    k = n_neighbors
    safe = threshold * k / (k - 1) if k > 1 else 0.0
    queries = tree.points.select(F.col("at").alias("q"))
    # a hair less, so that rounding cannot clear a row at the very limit
    open_queries = count_within(queries, tree, safe * (1 - 1e-9), k).where(F.col("found") < k).select("q")
    found = nearest(open_queries, tree, k).groupBy("q").agg(
        (F.sum(F.sqrt("squared") * F.col("take")) / F.sum("take")).alias("mean"))
    return _rows_at(df, names, found.where(F.col("mean") > threshold), tree, k)


def seasonal_residual(
    df: DataFrame, column: str, order_by: str, period: int, threshold: float = 1.5, by: Columns = None,
) -> DataFrame:
    """Rows whose residual after trend and season exceeds the threshold in size."""
    parts = decompose(df, column, order_by, period, by)
    return parts.where(F.abs("residual") > threshold).select(*df.columns)


_METHODS = {
    "3sigma": (three_sigma, "column"), "iqr": (iqr, "column"), "zscore": (z_score, "column"),
    "isolation_forest": (isolation_forest, "columns"), "svm": (one_class_svm, "columns"),
    "dbscan": (dbscan_noise, "columns"), "knn": (knn_distance, "columns"), "stl": (seasonal_residual, "column"),
}


def detect_anomalies(
    df: DataFrame, method: str, column: str | None = None, columns: Columns = None, **options,
) -> DataFrame:
    """Anomalous rows by method name; `column` or `columns` as the method needs."""
    if method not in _METHODS:
        raise ValueError(f"Method '{method}' not supported.")
    detect, takes = _METHODS[method]
    return detect(df, column if takes == "column" else columns, **options)
