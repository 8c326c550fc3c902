"""Models on planted data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lodestat.operators import features, metrics, models, series
from lodestat.plans.minimise import minimise
from lodestat.sources import models as saved

NAMES = [f"f{i}" for i in range(5)]


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(100, 5))
    data = pd.DataFrame(x, columns=NAMES).assign(id=range(100), target=x @ [10, 20, -5, 3, 8] + 4 + rng.normal(scale=0.1, size=100))
    return spark.createDataFrame(data)


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(7)
    y = np.arange(150) % 3
    x = rng.normal(size=(150, 2)) + np.array([[0, 0], [6, 0], [0, 6]])[y]
    return spark.createDataFrame(pd.DataFrame({"id": range(150), "a": x[:, 0], "b": x[:, 1], "label": y}))


def r2(df, target="target"):
    return metrics.regression_metrics(df, target).first()["r2"]


def test_split_and_linear_regression(regression):
    train, test = features.split(regression, "id")
    assert (train.count(), test.count()) == (80, 20)
    model = models.linear_regression(train, NAMES, "target")
    scores = model.scores(test).first()
    assert scores["r2"] > 0.99 and scores["mse"] < 1
    assert model.transform(test).count() == 20
    found = {r["term"]: r["coefficient"] for r in model.coefficients().collect()}
    assert found["f1"] == pytest.approx(20, abs=0.2) and found["intercept"] == pytest.approx(4, abs=0.2)


def test_non_negative(regression):
    model = models.linear_regression(regression, NAMES, "target", positive=True)
    w = model.info["coefficients"]
    assert min(w) >= 0 and w[2] == 0 and r2(model.transform(regression)) > 0.9


def test_polynomial(spark):
    df = spark.range(50).select((F.col("id") / 10.0).alias("x"), (F.col("id") % 7).cast("double").alias("z"))
    df = df.withColumn("y", 1 + 2 * F.col("x") + 3 * F.col("x") * F.col("z") - F.col("z") * F.col("z"))
    found = {r["term"]: r["coefficient"] for r in models.polynomial_regression(df, ["x", "z"], "y").coefficients().collect()}
    for term, value in {"x": 2, "x^2": 0, "z": 0, "x*z": 3, "z^2": -1, "intercept": 1}.items():
        assert found[term] == pytest.approx(value, abs=1e-6)


def test_ridge(spark):
    df = spark.createDataFrame([(1., 3., 1.), (2., 1., 2.5), (2., 5., 3.), (4., 5., 1.), (3., -1., 7.)], "a double, b double, y double")
    found = {r["term"]: r["coefficient"] for r in models.ridge_regression(df, ["a", "b"], "y", alpha=2).coefficients().collect()}
    assert found["a"] == pytest.approx(0.379771, abs=1e-5) and found["b"] == pytest.approx(-0.667939, abs=1e-5)


@pytest.mark.parametrize("fit", [
    lambda d: models.decision_tree(d, NAMES, "target"),
    lambda d: models.random_forest(d, NAMES, "target", n_estimators=10, max_depth=8),
    lambda d: models.gradient_boosting(d, NAMES, "target", n_estimators=10),
])
def test_tree_regressors(regression, fit):
    model = fit(regression)
    assert r2(model.transform(regression)) > 0.5
    assert sum(r["importance"] for r in model.importances().collect()) == pytest.approx(1)


@pytest.mark.parametrize("fit", [
    lambda d: models.decision_tree(d, ["a", "b"], "label", "classification"),
    lambda d: models.random_forest(d, ["a", "b"], "label", "classification", n_estimators=5, max_depth=4),
    lambda d: models.gradient_boosting(d, ["a", "b"], "label", "classification", n_estimators=3),
    lambda d: models.svm_classifier(d, ["a", "b"], "label", kernel="linear", max_iter=20),
    lambda d: models.svm_classifier(d, ["a", "b"], "label", kernel="rbf", max_iter=20),
])
def test_classifiers(classes, fit):
    model = fit(classes)
    assert model.scores(classes).first()["accuracy"] > 0.9
    report = {r["class"]: r for r in model.report(classes).collect()}
    assert report["0"]["support"] == 50 and report["weighted avg"]["support"] == 150


def test_svm_regression(regression):
    for kernel, least in (("linear", 0.95), ("rbf", 0.7)):
        model = models.svm_regression(features.scale(regression, "target"), NAMES, "target", kernel=kernel, size=96)
        assert model.scores(features.scale(regression, "target")).first()["r2"] > least


def test_grid_search(regression):
    best, parameters, score, table = models.grid_search(
        regression, NAMES, "target", param_grid={"n_estimators": [3], "max_depth": [1, 5]}, cv=3, key="id")
    assert parameters["maxDepth" if "maxDepth" in parameters else "max_depth"] == 5
    assert score == pytest.approx(max(r["score"] for r in table.collect()))
    assert best.transform(regression).count() == 100


def test_cross_validation(regression):
    scores = features.cross_validation(
        regression, lambda rows: models.linear_regression(rows, NAMES, "target"), r2, "id").collect()
    assert len(scores) == 5 and min(s["score"] for s in scores) > 0.99


def test_preprocessing(regression):
    rows = features.preprocess(regression.drop("id"), "target", {"n_features": 3})
    assert len(rows.first()["features"]) <= 3
    own = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features")])
    assert len(features.preprocess(regression, pipeline=own).first()["features"]) == 5


def test_saved_model(regression, tmp_path):
    path = str(tmp_path / "model")
    model = models.decision_tree(regression, NAMES, "target", max_depth=3)
    saved.save_model(model, path)
    want = model.transform(regression).orderBy("id").select("prediction").collect()
    got = saved.score_saved(regression.withColumnRenamed("f0", "old"), path, lambda d: d.withColumnRenamed("old", "f0"))
    assert got.orderBy("id").select("prediction").collect() == want


def test_forecasts_continue_a_seasonal_line(spark):
    days = pd.date_range("2024-01-01", periods=60)
    season = np.array([3.0, -1, 0, 2, -4, 1, -1])
    line = lambda t: 10 + 0.5 * t + season[t % 7]
    data = pd.DataFrame({"k": "a", "ts": days, "value": line(np.arange(60))})
    df = spark.createDataFrame(data).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = series.forecast(df, "exponential_smoothing", "k", horizon=7, period=7).orderBy("step").toPandas()
    assert np.allclose(got["forecast"], line(np.arange(60, 67)), atol=1e-6)
    assert got["ts"].iloc[0] == pd.Timestamp("2024-03-01")
    auto = series.forecast(df, "auto_arima", "k", horizon=7, period=7).orderBy("step").toPandas()
    assert np.allclose(auto["forecast"], line(np.arange(60, 67)), atol=0.5)
    with pytest.raises(ValueError):
        series.forecast(df, "crystal_ball", "k")


def test_arima_follows_an_autoregression():
    rng = np.random.default_rng(0)
    steps = np.zeros(400)
    for t in range(1, 400):
        steps[t] = 0.7 * steps[t - 1] + rng.normal()
    residuals, ahead, _ = series.arima(np.cumsum(steps), 3, (1, 1, 0))
    assert np.nanstd(residuals) == pytest.approx(1, abs=0.1) and len(ahead) == 3


def test_prepare_fills_the_calendar(spark):
    df = spark.createDataFrame([("a", "2024-01-01 05:00:00", 1.0), ("a", "2024-01-03 05:00:00", 2.0)], "k string, t string, v double")
    rows = series.prepare_series(df.withColumn("t", F.col("t").cast("timestamp_ntz")), "t", "v", "k").orderBy("ts").collect()
    assert [r["value"] for r in rows] == [1.0, 0.0, 2.0]


def test_many_rows_of_equal_features_are_fitted_as_one(spark, monkeypatch):
    rows = spark.range(4000).selectExpr(
        "double(id % 7) AS a", "double(id % 5) AS b", "(id % 7) * 2.0 - (id % 5) + (id % 3) AS y", "int((id % 7) * 3 > (id % 5) * 4) AS c")
    kept = models._together(rows, ["a", "b"], "y", "regression")
    assert kept.count() == 35 and kept.agg(F.sum(models._WEIGHT)).first()[0] == 4000
    joined = [models.gradient_boosting(rows, ["a", "b"], t, k, n_estimators=4) for t, k in (("y", "regression"), ("c", "classification"))]
    monkeypatch.setattr(models, "SHARED_ROWS", 10**9)
    assert models._together(rows, ["a", "b"], "y", "regression") is rows
    for model, (t, k) in zip(joined, (("y", "regression"), ("c", "classification"))):
        plain = models.gradient_boosting(rows, ["a", "b"], t, k, n_estimators=4).scores(rows).first()
        assert list(model.scores(rows).first()) == pytest.approx(list(plain), rel=1e-6)


def test_labels_of_equal_points_are_gathered(spark, monkeypatch):
    """No lifted rows are kept: a table of few points is kept as these and its labels."""
    monkeypatch.setattr(models, "_LABELS", 16)
    rows = spark.range(0, 1000, 1, 2).selectExpr("array(double(id % 4), double(id % 2)) AS x", "double(id) AS y")
    found = models._gathered(rows).collect()
    assert len(found) == 2 * 4 * 8 and max(len(r["y"]) for r in found) == 16
    assert sorted(v for r in found for v in r["y"]) == list(range(1000))
    assert all(r["x"] == [v % 4, v % 2] for r in found for v in r["y"])


def test_machines_of_pairs_keep_to_the_most_frequent_class_where_little_tells_them_apart(spark):
    """One against the rest, no class of less than half the rows wins a machine and chance decides."""
    rng = np.random.default_rng(3)
    y = rng.choice(3, 3000, p=[0.4, 0.3, 0.3])
    x = rng.normal(size=(3000, 3))
    x[(y == 1) & (rng.random(3000) < 0.3)] += [5, 0, 0]
    rows = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(label=np.array(["p", "q", "r"])[y]))
    found = models.svm_classifier(rows, ["a", "b", "c"], "label", kernel="linear").transform(rows)
    assert found.where("prediction = label").count() > np.bincount(y).max() + 100


def test_machines_of_all_classes_share_their_passes(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(models, "vector_sum", lambda df, terms, size, own=models.vector_sum: passes.append(size) or own(df, terms, size))
    rng = np.random.default_rng(5)
    y = np.arange(400) % 8
    x = rng.normal(size=(400, 2)) + 9 * np.stack([np.cos(y * np.pi / 4), np.sin(y * np.pi / 4)], axis=1)
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": y}))
    assert models.svm_classifier(rows, ["a", "b"], "label", kernel="linear", max_iter=20).scores(rows).first()["accuracy"] > 0.95
    assert passes[0] == 28 * 4 and len(passes) < 200


def test_functions_are_minimised_side_by_side():
    rng = np.random.default_rng(0)
    goal, scale = rng.normal(size=(5, 4)), rng.uniform(0.5, 20, size=(5, 4))

    def evaluate(points, of):
        gap = points - goal[of]
        return (scale[of] * gap ** 2).sum(axis=1), 2 * scale[of] * gap

    found, settled = minimise(evaluate, np.zeros((5, 4)), 100, flat=1e-8, still=0.0)
    assert settled.all() and np.allclose(found, goal, atol=1e-6)
