"""Feature preparation: imputing, scaling, selection, projection and splitting."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import PCA, SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestat.functions.columns import Columns, numeric_columns, pick, present
from lodestat.functions.distributions import f_tail
from lodestat.operators.clean import fill_missing, fill_values
from lodestat.plans.sizing import fits_broadcast, text_sizes

DEFAULTS = {
    "imputation": "mean", "scaling": "standard", "select": "f_regression", "n_features": 10,
    "reduce": "pca", "n_components": 0.95,
}


def impute(df: DataFrame, columns: Columns = None, strategy: str = "mean") -> DataFrame:
    """Fill gaps with the mean, the interpolated median or the smallest mode."""
    if strategy not in ("mean", "median", "mode"):
        raise ValueError(f"Unknown imputation '{strategy}'.")
    return fill_missing(df, columns, strategy)


def _scaling(df: DataFrame, columns: Sequence[str], kind: str) -> dict[str, tuple[float, float]]:
    """(shift, width) per column; a constant column has width 1."""
    exprs = {c: present(df, c).cast("double") for c in columns}
    if not exprs:
        return {}
    if kind == "standard":
        aggs = (F.avg, F.stddev_pop)
    elif kind == "minmax":
        aggs = (F.min, lambda e: F.max(e) - F.min(e))
    else:
        raise ValueError(f"Unknown scaling '{kind}'.")
    row = df.agg(*[agg(e).alias(f"s{i}_{j}") for i, e in enumerate(exprs.values()) for j, agg in enumerate(aggs)]).first()
    return {c: (row[f"s{i}_0"] or 0.0, row[f"s{i}_1"] or 1.0) for i, c in enumerate(exprs)}


def scale(df: DataFrame, columns: Columns = None, kind: str = "standard") -> DataFrame:
    """(x - mean) / population deviation, or the position between min and max."""
    names = pick(df, columns, numeric_columns(df))
    return df.withColumns({
        c: (present(df, c).cast("double") - F.lit(shift)) / F.lit(width)
        for c, (shift, width) in _scaling(df, names, kind).items()
    })


def feature_scores(df: DataFrame, target: str, columns: Columns = None) -> DataFrame:
    """(feature, correlation, f_score, p_value, place): linear F-test with the target."""
    names = [c for c in pick(df, columns, numeric_columns(df)) if c != target]
    y = present(df, target).cast("double")
    row = df.agg(F.count(F.lit(1)), *[
        a for i, c in enumerate(names) for x in [present(df, c).cast("double")]
        for a in (F.corr(x, y).alias(f"r{i}"), F.count(x + y).alias(f"n{i}"))
    ]).first()
    scores = []
    for i, c in enumerate(names):
        r, dof = row[f"r{i}"], row[f"n{i}"] - 2  # rows with both values count
        if r is None or math.isnan(r) or dof < 1:
            scores.append((c, None, None, None))
            continue
        f = math.inf if r * r >= 1 else r * r / (1 - r * r) * dof
        scores.append((c, r, f, f_tail(f, 1, dof)))
    scores.sort(key=lambda s: (s[2] is None, -(s[2] or 0.0), s[0]))
    return df.sparkSession.createDataFrame(
        [(*s, i + 1) for i, s in enumerate(scores)],
        "feature string, correlation double, f_score double, p_value double, place int")


def best_features(df: DataFrame, target: str, columns: Columns = None, k: int = 10) -> list[str]:
    """The k features with the highest score, in table order."""
    ranked = [r["feature"] for r in feature_scores(df, target, columns).where(F.col("place") <= k).collect()]
    return [c for c in df.columns if c in ranked]


def select_k_best(df: DataFrame, target: str, columns: Columns = None, k: int = 10) -> DataFrame:
    return df.select(*best_features(df, target, columns, k), target)


def principal_components(df: DataFrame, column: str = "features", n_components: float | int = 0.95) -> list[Transformer]:
    """Stages that project a centred vector column to `<column>_reduced`.

    A share below 1 keeps the fewest components that explain more than it.
    """
    size = len(df.select(column).first()[0])
    whole = isinstance(n_components, int) and n_components >= 1
    model = PCA(k=min(int(n_components), size) if whole else size, inputCol=column, outputCol="_projected").fit(df)
    explained = np.cumsum(model.explainedVariance.toArray())
    keep = len(explained) if whole else min(len(explained), int(np.searchsorted(explained, n_components, "right")) + 1)
    cut = VectorSlicer(inputCol="_projected", outputCol=f"{column}_reduced", indices=list(range(keep)))
    return [model, cut]


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _literal(value: float) -> str:
    return f"{float(value)!r}D"


def fit_preprocessing(df: DataFrame, target: str | None, config: Mapping | None = None) -> PipelineModel:
    """Impute, scale, select and reduce the numeric columns into `features`.

    The fitted statistics become literals of SQL stages, so the pipeline runs in
    generated code and can be saved. Fit it on the training rows alone to keep
    test rows out of the statistics. Columns without any value are left out.
    Every row is kept; one with a gap (only without imputation) gets NaN features.
    """
    config = DEFAULTS | dict(config or {})
    names = [c for c in numeric_columns(df) if c != target]
    seen = df.agg(F.count(F.lit(1)), *[F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    names = [c for i, c in enumerate(names) if seen[f"n{i}"]]
    if not names:
        raise ValueError("No numeric column holds a value.")
    stages: list[Transformer] = []

    def project(expressions: Mapping[str, str]) -> None:
        kept = [expressions.get(c, _quoted(c)) + f" AS {_quoted(c)}" for c in df.columns]
        stages.append(SQLTransformer(statement=f"SELECT {', '.join(kept)} FROM __THIS__"))

    current = df
    if config["imputation"]:
        fills = fill_values(df, names, config["imputation"])
        project({
            c: f"coalesce(nullif(cast({_quoted(c)} AS double), double('NaN')), {_literal(v)})"
            for c, v in fills.items() if v is not None
        })
        current = stages[-1].transform(current)
    if config["scaling"]:
        project({
            c: f"((cast({_quoted(c)} AS double) - {_literal(shift)}) / {_literal(width)})"
            for c, (shift, width) in _scaling(current, names, config["scaling"]).items()
        })
        current = stages[-1].transform(current)
    if config["select"] and target is not None:
        names = best_features(current, target, names, config["n_features"])
    reduce = config["reduce"] == "pca"
    assembled = VectorAssembler(
        inputCols=names, outputCol="_assembled" if reduce else "features", handleInvalid="keep")
    stages.append(assembled)
    if reduce:
        model, cut = principal_components(assembled.transform(current.dropna(subset=names)), "_assembled", config["n_components"])
        cut.setOutputCol("features")
        stages += [model, cut]
    return PipelineModel(stages)


def preprocess(
    df: DataFrame, target: str | None = None, config: Mapping | None = None, pipeline: Pipeline | None = None,
) -> DataFrame:
    """The table with a `features` vector, or whatever a given pipeline produces."""
    fitted = pipeline.fit(df) if pipeline is not None else fit_preprocessing(df, target, config)
    return fitted.transform(df)


# --- splitting -------------------------------------------------------------

_HASH_BITS = 16


def _hash(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(*keys, F.lit(seed))


def mark_test(
    df: DataFrame, key: Columns, test_size: float = 0.2, seed: int = 42, stratify: Columns = None,
) -> DataFrame:
    """Add `is_test`, true for exactly ceil(test_size * n) rows (per stratum:
    the rounded share). `key` must identify the rows.

    The test rows are those with the smallest hashes of their key. Counting rows
    by the top bits of the hash finds the bucket with the last test row, and
    ordering that bucket alone (one of 65536) finds the row. What remains is a
    comparison with that row, so nothing is sorted or gathered as a whole.
    """
    keys, strata = pick(df, key, []), pick(df, stratify, [])
    stratum = F.struct(*strata) if strata else F.lit(0)  # NULLs in a struct equal each other
    mine = F.struct(_hash(keys, seed).alias("h"), F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("k"))
    rows = df.select(stratum.alias("_stratum"), mine.alias("row"))
    rows = rows.withColumn("b", F.shiftright("row.h", 64 - _HASH_BITS))
    group = Window.partitionBy("_stratum")  # at most 65536 bucket rows per stratum
    counts = rows.groupBy("_stratum", "b").agg(F.count(F.lit(1)).alias("n")).select(
        "_stratum", "b", "n", F.sum("n").over(group).alias("total"),
        F.coalesce(F.sum("n").over(group.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    share = F.col("total") * F.lit(float(test_size))
    wanted = (F.round(share) if strata else F.ceil(F.round(share, 9))).cast("long")
    cuts = counts.withColumn("left", wanted - F.col("before")).where("left > 0 and left <= n").select("_stratum", "b", "left")
    if not strata:
        cuts = F.broadcast(cuts)  # one row
    place = F.row_number().over(Window.partitionBy("_stratum", "b").orderBy("row"))
    last = rows.join(cuts, ["_stratum", "b"]).withColumn("place", place).where("place = left").select("_stratum", F.col("row").alias("_last"))
    if strata:  # one row per stratum, sent to every executor where these are small
        if fits_broadcast(*text_sizes(df, {"s": F.to_json(stratum)})["s"]):
            last = F.broadcast(last)
        joined = df.withColumn("_stratum", stratum).join(last, "_stratum", "left")
        return joined.select(*df.columns, F.coalesce(mine <= F.col("_last"), F.lit(False)).alias("is_test"))
    row = last.first()
    if row is None:
        return df.withColumn("is_test", F.lit(False))
    limit = F.struct(F.lit(row["_last"]["h"]).alias("h"), F.struct(*[
        F.lit(v).cast(df.schema[name].dataType).alias(f"k{i}") for i, (v, name) in enumerate(zip(row["_last"]["k"], keys))
    ]).alias("k"))
    return df.withColumn("is_test", mine <= limit)


def split(
    df: DataFrame, key: Columns, test_size: float = 0.2, seed: int = 42, stratify: Columns = None,
) -> tuple[DataFrame, DataFrame]:
    """(train, test) of exact sizes, the same on every run."""
    marked = mark_test(df, key, test_size, seed, stratify)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def with_fold(df: DataFrame, key: Columns, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add `fold`, a hash of the key from 0 to folds - 1."""
    return df.withColumn("fold", F.pmod(_hash(pick(df, key, []), seed), F.lit(folds)).cast("int"))


def cross_validation(
    df: DataFrame, fit: Callable[[DataFrame], object], score: Callable[[DataFrame], float],
    key: Columns, cv: int = 5, seed: int = 42,
) -> DataFrame:
    """(fold, score): fit on the other folds, score the predictions on each one.

    `fit` takes rows and returns a model with `transform`.
    """
    folds = with_fold(df, key, cv, seed).persist()
    try:
        scores = []
        for i in range(cv):
            model = fit(folds.where(F.col("fold") != i).drop("fold"))
            scores.append((i, float(score(model.transform(folds.where(F.col("fold") == i).drop("fold"))))))
    finally:
        folds.unpersist()
    return df.sparkSession.createDataFrame(scores, "fold int, score double")
