"""Nothing is lost, dropped, renamed or decided by size."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from lodestat.functions.distributions import mann_whitney_p
from lodestat.operators import anomaly, clean, convert, edit, metrics, models, profile, series
from lodestat.sources import models as saved, tables


def test_save_over_the_source(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    edited = spark.read.parquet(path).where("id > 3")
    assert tables.save_table(edited, path).count() == 6
    broken = spark.read.parquet(path).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        tables.save_table(broken, path)
    assert spark.read.parquet(path).count() == 6


def test_quoted_line_breaks_and_long_numbers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,wide,note\n1234567890123456789,99999999999999999999,"two\nlines"\n2,1,plain\n')
    df = tables.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "wide": "string", "note": "string"}
    assert {(r.id, r.note) for r in df.collect()} == {(1234567890123456789, "two\nlines"), (2, "plain")}
    docs = spark.createDataFrame([(1, "[]"), (2, "{"), (3, '{"a": 1}')], "k int, d string")
    assert {r.k for r in tables.json_rejects(docs, "d", ("k",)).collect()} == {2, 3}


def brute_p(u, n1, n2):
    ways = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1)]
    return min(1.0, 2 * sum(w <= min(u, n1 * n2 - u) for w in ways) / len(ways))


def test_exact_rank_test_has_no_size_switch():
    for n1, n2 in ((2, 5), (4, 4), (6, 3)):
        for u in range(n1 * n2 + 1):
            assert math.isclose(mann_whitney_p(u, n1, n2, 0), brute_p(u, n1, n2))
    a, b = mann_whitney_p(0, 8, 62_500, 0), mann_whitney_p(0, 8, 62_501, 0)
    assert 0.999 < b / a < 1


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "Jan 5, 2024", "3/4/2024 1:05 PM", "x")], "a string, b string, c string, d string")
    row = convert.to_datetime(df).first()
    assert (row.a.isoformat(), row.b.isoformat(), row.c.isoformat(), row.d) == (
        "2024-01-01T00:00:00", "2024-01-05T00:00:00", "2024-03-04T13:05:00", "x")


def test_cells_can_be_cleared(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k int, v int")
    edits = spark.createDataFrame([(1, "v", None), (2, "v", "9"), (3, "v", "bad")], "k int, column string, value string")
    assert sorted((r.k, r.v) for r in edit.apply_edits(df, edits, "k", "v").collect()) == [(1, None), (2, 9), (3, 7)]
    assert [r.k for r in edit.bad_edits(df, edits, "v").collect()] == [3]


NAMES = ["n", "total", "x", "q", "i", "value"]


@pytest.fixture
def clashing(spark):
    rows = [(float(k), *[float((k * (j + 3)) % 17) for j in range(len(NAMES))]) for k in range(60)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ["k", *NAMES]))


def test_names_do_not_clash(clashing):
    assert profile.duplicate_count(clashing.drop("k")).first()[0] == 60 - clashing.drop("k").distinct().count()
    found = series.decompose(clashing, "value", "k", 5)
    assert found.count() == 60 and set(clashing.columns) < set(found.columns)
    assert anomaly.isolation_forest(clashing, ["x", "n"]).columns == clashing.columns
    asked = models.knn_predict(clashing, clashing, ["x", "i"], "total", "k")
    assert asked.columns == [*clashing.columns, "prediction"] and asked.count() == 60
    assert clean.clean_duplicates(clashing, "k", ["n", "x"]).columns == clashing.columns
    model = models.linear_regression(clashing, ["n", "q"], "value")
    assert model.transform(clashing).columns == [*clashing.columns, "prediction"]


def test_crowded_points_are_in_every_tree(spark):
    rows = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 100.0).alias("v"))
    drawn = anomaly._tree_samples(rows, ["v"], 20, 42, 256)
    per = drawn.groupBy("tree").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("x")[0] == 5.0).alias("hot")).collect()
    assert len(per) == 20 and all(r["rows"] == 256 and 40 < r["hot"] < 200 for r in per)


def test_labels_of_any_kind(spark):
    rows = spark.range(200).select(
        (F.col("id") % 20).cast("double").alias("a"), F.when(F.col("id") % 20 < 10, "low").otherwise("high").alias("name"),
        F.when(F.col("id") % 20 < 10, -1).otherwise(1).alias("sign"))
    for target in ("name", "sign"):
        for fit in (lambda: models.decision_tree(rows, ["a"], target, "classification", max_depth=3),
                    lambda: models.svm_classifier(rows, ["a"], target, kernel="linear")):
            found = fit().transform(rows)
            assert dict(found.dtypes)["prediction"] == dict(rows.dtypes)[target]
            assert found.where(F.col("prediction") != F.col(target)).count() < 10
    with pytest.raises(ValueError):
        models.decision_tree(rows, ["a"], "sign", max_depth=31)


def test_rows_with_gaps_stay(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 6.0), (float("nan"), 8.0), (3.0, 6.0)], "a double, y double")
    found = models.linear_regression(rows, ["a"], "y").transform(rows)
    assert found.count() == 5 and found.where("prediction IS NULL").count() == 2
    assert metrics.regression_metrics(found, "y").first()["r2"] == pytest.approx(1.0)
    guess = spark.createDataFrame([(1, 1.0), (0, 0.0)], "y int, prediction double")
    assert {(r["class"], r.recall) for r in metrics.classification_report(guess, "y").collect()} >= {("1", 1.0), ("0", 1.0)}


def test_own_stages_can_be_saved(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") / 10.0).alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") * 2.0).alias("y"))
    for i, model in enumerate((
            models.linear_regression(rows, ["a", "b"], "y", positive=True), models.svm_regression(rows, ["a", "b"], "y", size=16))):
        saved.save_model(model, str(tmp_path / str(i)))
        want = [r.prediction for r in model.transform(rows).orderBy("a").collect()]
        assert [r.prediction for r in saved.score_saved(rows, str(tmp_path / str(i))).orderBy("a").collect()] == pytest.approx(want)


def test_rows_without_a_key_stay(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c"), (4, "a")], "k int, v string")
    assert {r.v for r in clean.clean_duplicates(rows, "k").collect()} == {"a", "b", "c"}
    assert [tuple(r) for r in clean.find_duplicates(rows, "k").collect()] == [(4, "a")]
    two = rows.withColumn("z", F.lit(None).cast("int"))
    assert {r.k for r in clean.clean_duplicates(two, ["z", "k"]).collect()} == {1, None, 3}


def test_contradicting_edits_leave_the_cell(spark):
    df = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "k int, v string")
    edits = spark.createDataFrame(
        [(1, "v", "x"), (1, "v", "y"), (2, "v", "z"), (2, "v", "z"), (3, "v", None), (3, "v", "s")], "k int, column string, value string")
    assert sorted((r.k, r.v) for r in edit.apply_edits(df, edits, "k", "v").collect()) == [(1, "p"), (2, "z"), (3, "r")]
    assert sorted((r.k, r.value or "") for r in edit.bad_edits(df, edits, "v").collect()) == [(1, "x"), (1, "y"), (3, ""), (3, "s")]


def test_scores_of_text_labels(spark):
    rows = spark.range(40).select((F.col("id") % 20).cast("double").alias("a"), F.when(F.col("id") % 20 < 10, "class a").otherwise("class b").alias("name"))
    assert models.decision_tree(rows, ["a"], "name", "classification").scores(rows).first()["accuracy"] == 1.0
    guess = spark.createDataFrame([("x", "x"), ("y", "x"), (None, "x"), ("y", None)], "label string, prediction string")
    assert metrics.accuracy(guess, "label").first()["accuracy"] == 0.5
    flags = spark.createDataFrame([(True, "true"), (False, "perhaps")], "label boolean, prediction string")
    assert metrics.accuracy(flags, "label").first()["accuracy"] == 1.0
