"""Supervised models. Every fit returns a `Model` whose `transform` adds
`prediction`; MLlib does the work wherever it has the estimator."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial
from itertools import combinations, combinations_with_replacement, product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import IndexToString, PolynomialExpansion, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.util import inheritable_thread_target

from lodestat.functions.columns import Columns, numeric_columns, present, require
from lodestat.operators.features import _scaling, with_fold
from lodestat.operators.forests import SHARED_ROWS, ForestEstimator, Pruning, Settings, fit_trees
from lodestat.operators.metrics import accuracy, classification_report, regression_metrics
from lodestat.plans.layout import spread
from lodestat.plans.lineage import checkpoint, shuffles_dropped
from lodestat.plans.minimise import minimise
from lodestat.plans.neighbors import build_tree, nearest
from lodestat.plans.skew import join_values
from lodestat.plans.sums import FourierFeatures, vector_sum

DEEPEST = 30  # the largest depth that may be named; MLlib grows no deeper
# Usual names of scores, MLlib's names for them and their sign.
SCORING = {
    "neg_mean_squared_error": ("mse", -1), "neg_root_mean_squared_error": ("rmse", -1), "neg_mean_absolute_error": ("mae", -1),
    "f1_weighted": ("f1", 1), "precision_weighted": ("weightedPrecision", 1), "recall_weighted": ("weightedRecall", 1),
}
SEED = 42


@dataclass
class Model:
    """A fitted model over named feature columns."""

    task: str
    features: list[str]
    target: str
    fitted: Transformer
    info: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """All rows with `prediction`, NULL where a feature is missing; classes in the label's type."""
        found = with_known_predictions(self.fitted.transform(df), df, self.features)
        kind = self.info.get("label_type")
        return found.withColumn("prediction", F.col("prediction").cast(kind)) if kind else found

    def scores(self, df: DataFrame) -> DataFrame:
        """mse and r2, or the accuracy, of the predictions on rows with labels."""
        scored = self.transform(df)
        return regression_metrics(scored, self.target) if self.task == "regression" else accuracy(scored, self.target)

    def report(self, df: DataFrame) -> DataFrame:
        return classification_report(self.transform(df), self.target)

    def importances(self) -> DataFrame:
        """(feature, importance), which add up to 1."""
        tree = next(s for s in self.fitted.stages if hasattr(s, "featureImportances"))
        values = tree.featureImportances.toArray()
        rows = [(f, float(v)) for f, v in zip(self.features, values)]
        return SparkSession.active().createDataFrame(rows, "feature string, importance double")

    def coefficients(self) -> DataFrame:
        """(term, coefficient), the intercept included."""
        rows = [*zip(self.info["terms"], self.info["coefficients"]), ("intercept", self.info["intercept"])]
        return SparkSession.active().createDataFrame([(t, float(c)) for t, c in rows], "term string, coefficient double")


_WEIGHT = "_lodestat_weight"
_SCRATCH = ("_features", "_lifted", "_label", "_index", "rawPrediction", "probability")


def with_known_predictions(scored: DataFrame, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows as scored, without the columns scoring added besides `prediction`."""
    # one array instead of a condition per feature: the optimizer infers from each condition
    known = F.forall(F.array(F.lit(0.0), *[present(df, c).cast("double") for c in features]), lambda v: v.isNotNull())
    return scored.withColumn("prediction", F.when(known, F.col("prediction"))).drop(*[c for c in _SCRATCH if c not in df.columns])


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")


def _together(df: DataFrame, features: Sequence[str], target: str, task: str) -> DataFrame:
    """One row per distinct features, with the mean label and the number of rows in `_WEIGHT`, if that leaves far fewer.

    Of a classification rows of different labels stay apart. What sums weights
    and labels of rows with equal features finds the same.
    """
    own = list(dict.fromkeys([*require(df, features), *require(df, [target])]))
    whole = df.select(*own).dropna(subset=own)
    by = features if task == "regression" else own
    rows, distinct = whole.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*by))).first()
    if rows < SHARED_ROWS * distinct or target in features:
        return df
    if task == "regression":
        return whole.groupBy(*by).agg(F.avg(F.col(target).cast("double")).alias(target), F.count(F.lit(1)).cast("double").alias(_WEIGHT))
    return whole.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias(_WEIGHT))


def _depth(max_depth: int | None) -> int:
    if max_depth is not None and max_depth > DEEPEST:
        raise ValueError(f"Trees are at most {DEEPEST} levels deep.")
    return DEEPEST if max_depth is None else max_depth


@dataclass
class _Classes:
    """How the labels of a classification become the numbers 0 to k - 1 that MLlib needs."""

    count: int
    indexer: object = None     # NULL where the labels are such numbers already
    label_type: str | None = None

    def columns(self, target: str) -> dict:
        return {"labelCol": target} if self.indexer is None else {"labelCol": "_label", "predictionCol": "_index"}

    def around(self, stages: list) -> list:
        if self.indexer is None:
            return stages
        return [self.indexer, *stages, IndexToString(inputCol="_index", outputCol="prediction", labels=self.indexer.labels)]


def _classes(df: DataFrame, target: str) -> _Classes:
    """Text, booleans and any numbers may be labels; their sorted order gives the numbers."""
    rows = df.where(F.col(target).isNotNull())
    if target in numeric_columns(df):
        y = F.col(target).cast("double")
        row = rows.agg(F.min(y), F.max(y), F.count_distinct(y), F.count_if(y != F.floor(y))).first()
        if row[2] and row[0] == 0 and row[1] == row[2] - 1 and row[3] == 0:
            return _Classes(row[2])
    indexer = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc").fit(
        rows.select(F.col(target).cast("string").alias(target)) if target not in numeric_columns(df) else rows)
    return _Classes(len(indexer.labels), indexer, df.schema[target].dataType.simpleString())


def _fit(df, task, features, target, stages, repeated: bool = True, **info) -> Model:
    """Fit the stages on the columns they need, kept in memory if read repeatedly.

    Rows with a missing feature or label are left out of the fit.
    """
    features = require(df, features)
    require(df, [target])
    keep = [*features, target] + [c for c in ("fold", _WEIGHT) if c in df.columns]
    whole = df.select(*dict.fromkeys(keep)).dropna(subset=[*features, target])
    rows = spread(whole).persist() if repeated else whole
    try:
        fitted = Pipeline(stages=[_assembler(features), *stages]).fit(rows)
    finally:
        if repeated:
            rows.unpersist()
    for stage in fitted.stages:
        if isinstance(stage, StringIndexerModel):  # labels that the fit has not seen are no error when scoring
            stage.setHandleInvalid("keep")
    return Model(task, features, target, fitted, info)


def _linear(df, features, target, stages, estimator, terms) -> Model:
    model = _fit(df, "regression", features, target, [*stages, estimator], repeated=False)
    last = model.fitted.stages[-1]
    model.info = {"terms": terms, "coefficients": last.coefficients.toArray().tolist(), "intercept": last.intercept}
    return model


def linear_regression(
    df: DataFrame, features: Sequence[str], target: str, fit_intercept: bool = True, positive: bool = False,
) -> Model:
    """Least squares; with `positive` no coefficient may be negative.

    Few features are summed and scored by generated code, more by MLlib.
    """
    if positive:
        return _non_negative(df, features, target, fit_intercept)
    if len(features) <= _FEW:
        return _non_negative(df, features, target, fit_intercept, solve=_least_norm)
    return _linear(df, features, target, [], LinearRegression(
        featuresCol="_features", labelCol=target, solver="normal", fitIntercept=fit_intercept), list(features))


def polynomial_terms(features: Sequence[str], degree: int) -> list[str]:
    """Names of the expanded terms in the order MLlib produces them."""

    def expand(names: list[str], degree: int) -> list[str]:
        if not names or degree == 0:
            return [""]
        *head, last = names
        out = []
        for power in range(degree + 1):
            for term in expand(head, degree - power):
                own = "" if power == 0 else last if power == 1 else f"{last}^{power}"
                out.append("*".join(t for t in (term, own) if t))
        return out

    return expand(list(features), degree)[1:]


def polynomial_regression(df: DataFrame, features: Sequence[str], target: str, degree: int = 2) -> Model:
    """Least squares over all products of features up to a degree."""
    lift = PolynomialExpansion(degree=degree, inputCol="_features", outputCol="_lifted")
    terms = polynomial_terms(features, degree)
    estimator = LinearRegression(featuresCol="_lifted", labelCol=target, solver="normal")
    return _linear(df, features, target, [lift], estimator, terms)


def ridge_regression(
    df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, fit_intercept: bool = True,
    positive: bool = False,
) -> Model:
    """Least squares plus alpha * |w|^2, the exact solution; with `positive` no
    coefficient may be negative.

    MLlib scales its penalty by the deviation of the label and the row count,
    which is undone here.
    """
    if positive:
        return _non_negative(df, features, target, fit_intercept, alpha)
    row = df.dropna(subset=[*require(df, features), target]).agg(F.count(target).alias("n"), F.stddev_pop(target).alias("sd")).first()
    return _linear(df, features, target, [], LinearRegression(
        featuresCol="_features", labelCol=target, solver="normal", elasticNetParam=0.0, standardization=False,
        regParam=alpha * (row["sd"] or 0.0) / max(row["n"], 1), fitIntercept=fit_intercept), list(features))


class _Stored(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage whose state is one JSON text, so that a pipeline with it can be saved."""

    state = Param(Params._dummy(), "state", "the fitted numbers as JSON", TypeConverters.toString)

    @classmethod
    def of(cls, **state):
        made = cls()
        made._set(state=json.dumps(state))
        return made

    def held(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class LinearTransformer(_Stored):
    """Prediction as a sum of column times weight, in generated code."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = self.held()
        total = F.lit(float(held["intercept"]))
        for name, weight in held["weights"].items():
            total = total + F.col(name).cast("double") * F.lit(float(weight))
        return dataset.withColumn("prediction", total)


_FEW = 12  # features whose products fit one generated aggregate


def _least_norm(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """The least squares solution of least norm; features are brought to one scale first."""
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    return np.linalg.lstsq(gram / np.outer(scale, scale), moment / scale, rcond=1e-13)[0] / scale


def _non_negative(
    df: DataFrame, features: Sequence[str], target: str, fit_intercept: bool, alpha: float = 0.0, solve=None,
) -> Model:
    """Least squares, by default without negative coefficients, on the matrix of
    products, which one aggregate over the centred columns yields."""
    names = [*require(df, features), target]
    exprs = {c: present(df, c).cast("double") for c in names}
    whole = df.dropna(subset=names)
    row = whole.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(exprs.values())]).first()
    mean = np.array([row[f"m{i}"] if fit_intercept else 0.0 for i in range(len(names))])
    centred = [e - F.lit(float(m)) for e, m in zip(exprs.values(), mean)]
    cells = list(combinations_with_replacement(range(len(names)), 2))
    sums = whole.agg(*[F.sum(centred[i] * centred[j]).alias(f"p{i}_{j}") for i, j in cells]).first()
    gram = np.zeros((len(names), len(names)))
    for i, j in cells:
        gram[i, j] = gram[j, i] = sums[f"p{i}_{j}"]
    w = (solve or solve_non_negative)(gram[:-1, :-1] + alpha * np.eye(len(names) - 1), gram[:-1, -1])
    intercept = float(mean[-1] - mean[:-1] @ w) if fit_intercept else 0.0
    weights = dict(zip(features, w.tolist()))
    return Model("regression", list(features), target, PipelineModel([LinearTransformer.of(weights=weights, intercept=intercept)]),
                 {"terms": list(features), "coefficients": w.tolist(), "intercept": intercept})


def solve_non_negative(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Minimize w'Gw/2 - m'w over w >= 0 (Lawson and Hanson 1974)."""
    size = len(moment)
    w, free = np.zeros(size), np.zeros(size, dtype=bool)
    tolerance = 1e-12 * max(1.0, float(np.abs(moment).max(initial=0.0)))
    for _ in range(3 * size + 3):
        gain = moment - gram @ w
        gain[free] = -np.inf
        if not size or gain.max() <= tolerance:
            break
        free[int(np.argmax(gain))] = True
        while True:
            trial = np.zeros(size)
            trial[free] = np.linalg.lstsq(gram[np.ix_(free, free)], moment[free], rcond=None)[0]
            if (trial[free] > 0).all():
                w = trial
                break
            falling = free & (trial <= 0)
            step = np.min(w[falling] / (w[falling] - trial[falling]))
            w = w + step * (trial - w)
            free &= w > tolerance
            w[~free] = 0.0
    return w


# --- trees -----------------------------------------------------------------


def decision_tree(
    df: DataFrame, features: Sequence[str], target: str, task: str = "regression",
    max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1,
) -> Model:
    """One tree, by default of any depth; its nodes are a table (see `forests`)."""
    return _grown(df, features, target, task, 1, max_depth, min_samples_split, min_samples_leaf, alone=True)


def _fit_classes(
    df: DataFrame, features: Sequence[str], target: str, estimator, before: Sequence = (), repeated: bool = True, **info,
) -> Model:
    """Fit the classifier that `estimator` makes for the classes of the target."""
    found = _classes(df, require(df, [target])[0])
    return _fit(df, "classification", features, target, found.around([*before, estimator(found)]), repeated, label_type=found.label_type, **info)


def _forest_settings(
    task: str, classes: int, dims: int, trees: int, max_depth: int | None, split: int, leaf: int, alone: bool = False,
) -> Settings:
    subset = None if task == "regression" or alone else max(1, int(dims ** 0.5))
    return Settings(
        classes=classes, trees=trees, bagged=not alone, subset=subset, max_depth=None if max_depth is None else _depth(max_depth),
        min_samples_split=split, min_samples_leaf=leaf, seed=SEED)


def _grown(df, features, target, task, trees, max_depth, split, leaf, alone=False) -> Model:
    settings = partial(_forest_settings, task, dims=len(features), trees=trees, max_depth=max_depth, split=split, leaf=leaf, alone=alone)
    if task == "regression":
        return _fit(df, task, features, target, [ForestEstimator(settings(classes=0), target, features=list(features))], repeated=False)

    def estimator(c: _Classes) -> ForestEstimator:
        own = c.columns(target)
        return ForestEstimator(settings(classes=c.count), own["labelCol"], own.get("predictionCol", "prediction"), list(features))

    return _fit_classes(df, features, target, estimator, repeated=False)


def random_forest(
    df: DataFrame, features: Sequence[str], target: str, task: str = "regression",
    n_estimators: int = 100, max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1,
) -> Model:
    """Trees on rows drawn with replacement; a classification tries the square root of the features at each node."""
    return _grown(df, features, target, task, n_estimators, max_depth, min_samples_split, min_samples_leaf)


def gradient_boosting(
    df: DataFrame, features: Sequence[str], target: str, task: str = "regression",
    n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3,
) -> Model:
    """Boosted trees; more than two classes are fitted one against the rest. Many rows of equal features are fitted as one of their weight."""
    df = _together(df, features, target, task)
    options = dict(featuresCol="_features", maxIter=n_estimators, stepSize=learning_rate, maxDepth=_depth(max_depth), seed=SEED)
    if _WEIGHT in df.columns:
        options["weightCol"] = _WEIGHT
    if task == "regression":
        return _fit(df, task, features, target, [GBTRegressor(labelCol=target, **options)])
    return _fit_classes(df, features, target, lambda c: _one_against_rest(c, target, GBTClassifier(**c.columns(target), **options)))


def _one_against_rest(classes: _Classes, target: str, classifier):
    if classes.count <= 2:
        return classifier
    weights = {"weightCol": _WEIGHT} if classifier.isSet("weightCol") else {}
    return OneVsRest(classifier=classifier, featuresCol=classifier.getFeaturesCol(), parallelism=8, **weights, **classes.columns(target))


# The search's parameters and what is tried by default.
GRID = {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]}
_DEFAULTS = {"n_estimators": 100, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1}
_LESS = ("mse", "rmse", "mae", "hammingLoss")


def _answered(batches, classes: int, cells: int):
    """(fold, cell, y, said, n): how many rows of a class each cell's largest sum puts into which."""
    for batch in batches:
        said = np.asarray(batch.column("values").flatten(), float).reshape(-1, cells, classes).argmax(axis=2)
        fold, y, n = (np.asarray(batch.column(c)).astype(np.int64) for c in ("fold", "y", "n"))
        codes, at = np.unique((((fold[:, None] * cells + np.arange(cells)) * classes + y[:, None]) * classes + said).ravel(), return_inverse=True)
        many = np.bincount(at, np.repeat(n, cells), len(codes)).astype(np.int64)
        place, said = np.divmod(codes, classes)
        place, y = np.divmod(place, classes)
        fold, cell = np.divmod(place, cells)
        yield pa.RecordBatch.from_arrays(
            [pa.array(fold.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(y), pa.array(said), pa.array(many)], ["fold", "cell", "y", "said", "n"])


def _fold_scores(scored: DataFrame, classes: int, metric: str, trees: Sequence[int]) -> dict[int, dict[int, float]]:
    """fold: cell: score, from the (fold, y, values) of the rows, `values` with the sums of every cell one after another.

    A cell is the first so many `trees` under a pruning. Of a classification, a row stands for `n` equal ones.
    """
    cells = len(trees)
    if not classes:
        each = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.slice("values", i + 1, 1))).alias("cell", "own")
        rows = scored.select("fold", "y", each)
        gap = F.col("y") - F.get(F.col("own"), F.lit(0)) / F.get(F.array(*[F.lit(n) for n in trees]), F.col("cell"))
        sums = rows.groupBy("fold", "cell").agg(
            F.avg(gap * gap).alias("mse"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"),
            (1 - F.try_divide(F.sum(gap * gap), F.var_pop("y") * F.count("y"))).alias("r2"))
        found = sums.select("fold", "cell", F.col(metric).alias("score")).collect()
    else:
        told = scored.select("fold", "y", "n", "values").mapInArrow(
            partial(_answered, classes=classes, cells=cells), "fold int, cell int, y long, said long, n long")
        # read twice below, so that without a table of their own all rows would be scored twice
        counts = checkpoint(told.groupBy("fold", "cell", "y", "said").agg(F.sum("n").alias("n")))
        hit = F.when(F.col("y") == F.col("said"), F.col("n")).otherwise(0)
        real, named = Window.partitionBy("fold", "cell", "y"), Window.partitionBy("fold", "cell", "said")
        rated = counts.withColumns({"hit": hit, "real": F.sum("n").over(real), "named": F.sum("n").over(named)}).where("y = said")
        total = counts.groupBy("fold", "cell").agg(F.sum("n").alias("all"))
        p, r = F.col("hit") / F.col("named"), F.col("hit") / F.col("real")
        weighted = lambda v: F.coalesce(F.sum(F.col("real") * v), F.lit(0.0)) / F.max("all")
        scores = total.join(rated, ["fold", "cell"], "left").groupBy("fold", "cell").agg(
            weighted(r).alias("accuracy"), weighted(r).alias("weightedRecall"), weighted(p).alias("weightedPrecision"),
            weighted(2 * p * r / (p + r)).alias("f1"), (1 - weighted(r)).alias("hammingLoss"))
        found = scores.select("fold", "cell", F.col(metric).alias("score")).collect()
    out: dict[int, dict[int, float]] = {}
    for row in found:  # a row per fold and setting
        out.setdefault(row["fold"], {})[row["cell"]] = row["score"]
    return out


def grid_search(
    df: DataFrame, features: Sequence[str], target: str, task: str = "regression",
    param_grid: Mapping[str, Sequence] | None = None, cv: int = 5, scoring: str = "r2", parallelism: int = 4,
    key: Columns = None,
) -> tuple[Model, dict, float, DataFrame]:
    """(best model, its parameters, its score, all scores) of random forests, by default over the whole of GRID.

    A forest of fewer trees is the first trees of a larger one, and a tree of
    less depth or larger splits is a deeper one cut short. So each fold fits one
    forest per min_samples_leaf, of the most trees and the largest depth asked
    for, and scores every setting from it. Folds come from a hash of `key` if
    given, of the row otherwise. `scoring` is a name of SCORING, or one of r2,
    mse, rmse, mae, or accuracy, f1, weightedPrecision, weightedRecall,
    hammingLoss; where less is better, scores are negative with a `neg_` name.
    """
    grid = {n: list(v) for n, v in (GRID if param_grid is None else param_grid).items()}
    for name in grid:
        if name not in _DEFAULTS:
            raise ValueError(f"Unknown parameter '{name}'.")
    for depth in grid.get("max_depth", []):
        _depth(depth)
    metric, sign = SCORING.get(scoring, (scoring, 1))
    if task != "regression" and metric == "r2":
        metric = "accuracy"
    known = ("r2", "mse", "rmse", "mae") if task == "regression" else ("accuracy", "f1", "weightedPrecision", "weightedRecall", "hammingLoss")
    if metric not in known:
        raise ValueError(f"Unknown score '{scoring}'.")
    features, tried = require(df, features), {n: grid.get(n, [d]) for n, d in _DEFAULTS.items()}
    prefixes = sorted(set(tried["n_estimators"]))
    prunings = [Pruning(d, m) for d, m in product(dict.fromkeys(tried["max_depth"]), dict.fromkeys(tried["min_samples_split"]))]
    cells = {(n, p): i for i, (n, p) in enumerate(product(prefixes, prunings))}
    deepest = None if None in tried["max_depth"] else max(tried["max_depth"])
    classes = _classes(df, target) if task != "regression" else None
    whole = df.dropna(subset=[*features, require(df, [target])[0]])
    folded = with_fold(whole, key, cv) if key is not None else whole.withColumn(
        "fold", F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in [*features, target]], F.lit(SEED)), F.lit(cv)).cast("int"))
    label = target
    if classes and classes.indexer is not None:
        folded, label = classes.indexer.transform(folded), "_label"
    points = spread(folded.select(
        "fold", F.array(*[present(folded, c).cast("double") for c in features]).alias("x"), F.col(label).cast("double").alias("y"))).persist()
    cores = df.sparkSession.sparkContext.defaultParallelism

    def one(fold: int, leaf: int) -> dict[int, float]:
        settings = _forest_settings(task, classes.count if classes else 0, len(features), prefixes[-1], None, min(tried["min_samples_split"]), leaf)
        forest = fit_trees(points.where(F.col("fold") != fold), len(features), replace(settings, max_depth=deepest))
        asked = points.where(F.col("fold") == fold)
        if classes:  # equal rows are scored once, by all cores however few they are
            asked = asked.groupBy("fold", "x", "y").agg(F.count(F.lit(1)).alias("n")).repartition(cores)
        scored = forest.values(asked.withColumn("id", F.monotonically_increasing_id()), prunings, prefixes)
        return _fold_scores(scored, classes.count if classes else 0, metric, [n for n, _ in cells]).get(fold, {})

    try:
        runs = list(product(range(cv), dict.fromkeys(tried["min_samples_leaf"])))
        with shuffles_dropped(df.sparkSession), ThreadPool(min(parallelism, len(runs))) as pool:
            found = dict(zip(runs, pool.starmap(inheritable_thread_target(df.sparkSession)(one), runs)))
    finally:
        points.unpersist()
    settings = [dict(zip(tried, values)) for values in product(*tried.values())]
    scores = []
    for t in settings:
        cell = cells[t["n_estimators"], Pruning(t["max_depth"], t["min_samples_split"])]
        own = [found[fold, t["min_samples_leaf"]].get(cell) for fold in range(cv)]
        own = [v for v in own if v is not None]
        scores.append(float(np.mean(own)) if own else float("nan"))
    better = min if metric in _LESS else max
    at = better((i for i in range(len(settings)) if not np.isnan(scores[i])), key=lambda i: scores[i], default=0)
    model = random_forest(df, features, target, task, **settings[at])
    chosen = {n: v for n, v in settings[at].items() if n in grid}
    table = df.sparkSession.createDataFrame(
        [(i, str(sorted((n, v) for n, v in t.items() if n in grid)), sign * score) for i, (t, score) in enumerate(zip(settings, scores))],
        "place int, parameters string, score double")
    return model, chosen, sign * scores[at], table


# --- support vector machines -----------------------------------------------


class FourierTransformer(_Stored):
    """Random cosine features of a scaled vector, in Arrow batches."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        lift = FourierFeatures(*self.held()["features"])

        @F.pandas_udf("array<double>")
        def apply(points: pd.Series) -> pd.Series:
            return pd.Series(list(lift(np.stack(points.to_numpy())))) if len(points) else points

        return dataset.withColumn("_lifted", array_to_vector(apply(vector_to_array("_scaled")))).drop("_scaled")


def _lifting(kernel: str, dims: int, degree: int, size: int) -> list:
    """Stages from `_features` to the vector a linear machine is fitted on."""
    scaler = StandardScaler(inputCol="_features", withMean=True, withStd=True)
    if kernel == "linear":
        return [scaler.setOutputCol("_lifted")]
    if kernel == "poly":
        return [scaler.setOutputCol("_scaled"), PolynomialExpansion(degree=degree, inputCol="_scaled", outputCol="_lifted")]
    if kernel == "rbf":
        return [scaler.setOutputCol("_scaled"), FourierTransformer.of(features=[dims, 1.0 / dims, size, SEED])]
    raise ValueError(f"Unknown kernel '{kernel}'.")


def svm_classifier(
    df: DataFrame, features: Sequence[str], target: str, kernel: str = "rbf", C: float = 1.0,
    degree: int = 3, size: int = 128, max_iter: int = 50,
) -> Model:
    """Support vector classification on scaled features, one class against another for every two.

    The linear kernel is that of the exact machine but for the hinge, rounded
    over the last hundredth of its margin. `poly` uses all monomials up to the
    degree and `rbf` random Fourier features, both approximations of the kernel
    machine. `max_iter` limits the steps of each of three roundings.
    """
    def machine(classes: _Classes) -> PairsEstimator:
        own = classes.columns(target)
        return PairsEstimator(own["labelCol"], own.get("predictionCol", "prediction"), C, max_iter)

    return _fit_classes(df, features, target, machine, _lifting(kernel, len(features), degree, size), kernel=kernel)


_ROUNDED = (1.0, 0.1, 0.01)  # margins over which the hinge is rounded, one after another
_AT_ONCE = 1 << 18           # weights that are fitted together


class PairsEstimator(Estimator):
    """Linear machines on `_lifted`, one for every two classes; a pass over the table is a step of all of them."""

    def __init__(self, label: str, prediction: str, C: float, steps: int):
        super().__init__()
        self.label, self.prediction, self.C, self.steps = label, prediction, C, steps

    def _fit(self, dataset: DataFrame) -> PairsTransformer:
        rows = dataset.select(vector_to_array("_lifted").alias("x"), F.col(self.label).cast("int").alias("y")).persist()
        try:
            counts = dict(rows.groupBy("y").count().collect())  # a row per class
            if not counts:
                raise ValueError("There are no rows to fit a machine on.")
            pairs = np.array(list(combinations(sorted(counts), 2)), int).reshape(-1, 2)
            width = len(rows.first()["x"]) + 1
            at_once = max(1, _AT_ONCE // width)
            found = [_fit_pairs(rows, pairs[i:i + at_once], counts, width, self.C, self.steps) for i in range(0, len(pairs), at_once)]
        finally:
            rows.unpersist()
        return PairsTransformer.of(
            pairs=pairs.tolist(), weights=[w for part in found for w in part.tolist()], classes=max(counts) + 1, only=min(counts), prediction=self.prediction)


def _fit_pairs(rows: DataFrame, pairs: np.ndarray, counts: Mapping[int, int], width: int, C: float, steps: int) -> np.ndarray:
    """(pairs, width): weights and offset of the machine that tells each pair's first class, on the positive side, from its second."""
    many = np.array([counts[a] + counts[b] for a, b in pairs.tolist()], float)
    w = np.zeros((len(pairs), width))
    for rounded in _ROUNDED:

        def evaluate(points: np.ndarray, of: np.ndarray):
            own = {c: (np.flatnonzero((pairs[of] == c).any(axis=1)), np.where(pairs[of, 0] == c, 1.0, -1.0)) for c in counts}

            def terms(batch: pd.DataFrame) -> np.ndarray:
                x, y = np.column_stack([np.stack(batch["x"].to_numpy()), np.ones(len(batch))]), batch["y"].to_numpy()
                out = np.zeros((len(of), width + 1))
                for c in np.unique(y):
                    at, sign = own[c]
                    if len(at):
                        mine, side = x[y == c], sign[at]
                        short = np.maximum(0.0, 1.0 - (mine @ points[at].T) * side)
                        out[at, -1] += np.where(short < rounded, short ** 2 / (2 * rounded), short - rounded / 2).sum(axis=0)
                        out[at, :-1] -= (np.minimum(short / rounded, 1.0) * side).T @ mine
                return out.ravel()

            total = vector_sum(rows, terms, len(of) * (width + 1)).reshape(len(of), -1) / many[of, None]
            inner = points.copy()
            inner[:, -1] = 0.0  # the offset is free
            pull = 1.0 / (C * many[of])
            return total[:, -1] + pull / 2 * (inner ** 2).sum(axis=1), total[:, :-1] + pull[:, None] * inner

        # all but the last only give the next one its start
        w, _ = minimise(evaluate, w, steps, *(() if rounded == _ROUNDED[-1] else (1e-3, 1e-4)))
    return w


class PairsTransformer(_Stored):
    """The class that most machines vote for, the first of several, in Arrow batches."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = self.held()
        pairs, weights = np.array(held["pairs"], int).reshape(-1, 2), np.array(held["weights"])
        classes, only = held["classes"], held["only"]

        @F.pandas_udf("double")
        def apply(points: pd.Series) -> pd.Series:
            if not len(pairs) or not len(points):
                return pd.Series(np.full(len(points), float(only)))
            first = np.stack(points.to_numpy()) @ weights[:, :-1].T + weights[:, -1] > 0
            votes = np.zeros((len(points), classes), np.int32)
            for (a, b), side in zip(pairs, first.T):
                votes[:, a] += side
                votes[:, b] += ~side
            return pd.Series(votes.argmax(axis=1).astype(float))

        return dataset.withColumn(held["prediction"], apply(vector_to_array("_lifted")))


class DotTransformer(_Stored):
    """Prediction as a dot product of the lifted vector, in Arrow batches."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = np.array(self.held()["weights"])

        @F.pandas_udf("double")
        def apply(points: pd.Series) -> pd.Series:
            x = np.stack(points.to_numpy()) if len(points) else np.zeros((0, len(weights) - 1))
            return pd.Series(x @ weights[:-1] + weights[-1])

        return dataset.withColumn("prediction", apply(vector_to_array("_lifted")))


_GATHERED = 200_000  # rows looked at together
_LABELS = 256        # and labels in a row, so that a batch of rows stays small


def _gathered(df: DataFrame) -> DataFrame:
    """(x, y) with the labels of equal points in one array, as far as they are near each other in the table."""

    def gather(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _GATHERED:
                yield from together(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from together(pa.Table.from_batches(held))

    def together(table):
        flat = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x, y = flat.reshape(table.num_rows, -1), table.column("y").to_numpy()
        order = np.lexsort(x.T)
        x, y = x[order], y[order]
        first = np.append(True, (x[1:] != x[:-1]).any(axis=1))
        place = np.arange(len(x))
        starts = np.flatnonzero((place - np.maximum.accumulate(np.where(first, place, 0))) % _LABELS == 0)
        points = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * x.shape[1]), pa.array(x[starts].ravel()))
        labels = pa.ListArray.from_arrays(pa.array(np.append(starts, len(x)).astype(np.int32)), pa.array(y))
        yield from pa.table({"x": points, "y": labels}).to_batches(max_chunksize=10_000)

    return df.mapInArrow(gather, "x array<double>, y array<double>")


def svm_regression(
    df: DataFrame, features: Sequence[str], target: str, kernel: str = "rbf", C: float = 1.0,
    epsilon: float = 0.1, degree: int = 3, size: int = 64, steps: int = 200,
) -> Model:
    """Regression that ignores errors up to epsilon, on scaled features.

    Iteratively reweighted least squares: each step sums one weighted matrix of
    products over the table and solves it on the driver, until the weights move
    by less than 1e-4 of the largest; `info["converged"]` is False if `steps` did
    not suffice. Kernels as in `svm_classifier`.
    """
    whole = df.dropna(subset=[*require(df, features), *require(df, [target])])
    lifting = Pipeline(stages=[_assembler(features), *_lifting(kernel, len(features), degree, size)]).fit(whole)
    # the random features of a point are drawn again in each step instead of being kept
    random = isinstance(lifting.stages[-1], FourierTransformer)
    lift = FourierFeatures(*lifting.stages[-1].held()["features"]) if random else np.asarray
    scaled = (PipelineModel(lifting.stages[:-1]) if random else lifting).transform(whole)
    rows = _gathered(spread(scaled.select(
        vector_to_array("_scaled" if random else "_lifted").alias("x"), F.col(target).cast("double").alias("y")).where("y is not null"))).persist()
    try:
        width = lift(np.array([rows.first()["x"]])).shape[1] + 1

        def step_sums(w: np.ndarray | None):
            def terms(batch: pd.DataFrame) -> np.ndarray:
                x = np.column_stack([lift(np.stack(batch["x"].to_numpy())), np.ones(len(batch))])
                many, y = batch["y"].str.len().to_numpy(), np.concatenate(batch["y"].to_numpy())
                if w is None:
                    pull, goal = np.ones(len(y)), y
                else:
                    gap = y - np.repeat(x @ w, many)
                    over = np.abs(gap) - epsilon
                    # beyond epsilon the loss C * over becomes a square with this weight
                    pull = np.where(over > 0, C / np.maximum(over, 1e-3 * max(epsilon, 1e-3)), 0.0)
                    goal = y - np.sign(gap) * epsilon
                starts = np.cumsum(many) - many
                weighted = x * np.add.reduceat(pull, starts)[:, None]
                return np.concatenate([(x.T @ weighted).ravel(), x.T @ np.add.reduceat(pull * goal, starts)])
            return terms

        w, done = None, False
        damp = np.eye(width)
        damp[-1, -1] = 1e-9  # the offset is free
        for _ in range(steps):
            total = vector_sum(rows, step_sums(w), width * width + width)
            gram, moment = total[:width * width].reshape(width, width), total[width * width:]
            new = np.linalg.solve(gram + damp, moment)
            done = w is not None and np.abs(new - w).max() <= 1e-4 * max(1.0, np.abs(w).max())
            w = new
            if done:
                break
    finally:
        rows.unpersist()
    return Model("regression", list(features), target, PipelineModel([*lifting.stages, DotTransformer.of(weights=w.tolist())]),
                 {"kernel": kernel, "converged": bool(done)})


# --- nearest neighbours ----------------------------------------------------


def knn_predict(
    train: DataFrame, test: DataFrame, features: Sequence[str], target: str, key: str,
    task: str = "regression", n_neighbors: int = 5, weights: str = "uniform", scaled: bool = True,
) -> DataFrame:
    """The test rows with `prediction` from their nearest training rows, NULL where
    a feature is missing.

    Features are scaled by the training rows' mean and population deviation.
    Neighbours at equal distance are taken in the order of `key`, so of many
    training rows at one point only the first k can matter; the others are left
    out before the search. Test rows at one point are answered once.
    """
    features = require(train, features)
    require(test, features)
    if weights not in ("uniform", "distance"):
        raise ValueError("weights must be 'uniform' or 'distance'.")
    shifts = _scaling(train, features, "standard") if scaled else {c: (0.0, 1.0) for c in features}

    def at(df: DataFrame) -> Column:
        cols = [(present(df, c).cast("double") - F.lit(shifts[c][0])) / F.lit(shifts[c][1]) + F.lit(0.0) for c in features]
        return F.when(~sum((c.isNull().cast("int") for c in cols[1:]), cols[0].isNull().cast("int")).cast("boolean"), F.array(*cols))

    first = F.row_number().over(Window.partitionBy("at").orderBy("key"))
    points = (
        train.select(at(train).alias("at"), F.col(key).alias("key"), F.col(target).alias("y"))
        .where("at is not null and y is not null").withColumn("place", first)
        .where(F.col("place") <= n_neighbors).select("at", "key", "y", F.lit(1).cast("long").alias("w"))
    )
    tree = build_tree(points, len(features))
    asked = test.withColumn("_lodestat_q", at(test))
    questions = asked.where("_lodestat_q is not null").groupBy(F.col("_lodestat_q").alias("q")).agg(F.count(F.lit(1)).alias("_lodestat_n"))
    found = nearest(questions.select("q"), tree, n_neighbors, order=["key"])
    if weights == "distance":
        touching = F.min("squared").over(Window.partitionBy("q")) == 0
        found = found.withColumn("weight", F.when(touching, (F.col("squared") == 0).cast("double"))
                                 .otherwise(F.try_divide(F.lit(1.0), F.sqrt("squared"))))
    else:
        found = found.withColumn("weight", F.lit(1.0))
    if task == "regression":
        answers = found.groupBy("q").agg((F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("prediction"))
    else:
        votes = found.groupBy("q", "y").agg(F.sum("weight").alias("votes"))
        answers = votes.groupBy("q").agg(F.min_by("y", F.struct(-F.col("votes"), F.col("y"))).alias("prediction"))
    size = questions.agg(F.count(F.lit(1)).alias("points"), F.sum("_lodestat_n").alias("rows")).first()
    table = answers.join(questions, "q").withColumn("_lodestat_total", F.lit(size["rows"] or 0)).withColumnRenamed("q", "_lodestat_q")
    answered = join_values(
        asked.where("_lodestat_q is not null"), table, "_lodestat_q", size["points"], "_lodestat_n", "_lodestat_total")
    unknown = asked.where("_lodestat_q is null").withColumn("prediction", F.lit(None).cast(answers.schema["prediction"].dataType))
    names = [*test.columns, "prediction"]
    return answered.select(*names).unionByName(unknown.select(*names))
