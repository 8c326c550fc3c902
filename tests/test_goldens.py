"""Published examples and exact small cases."""

import math

import pytest
from pyspark.sql import functions as F

from lodestat.functions import distributions as dist
from lodestat.operators import clean, convert, correlation, edit, hypothesis, normalize, profile, validate
from lodestat.sources import tables

A = [8.88, 9.12, 9.04, 8.98, 9.00, 9.08, 9.01, 8.85, 9.06, 8.99]
B = [8.88, 8.95, 9.29, 9.44, 9.15, 9.58, 8.36, 9.18, 8.67, 9.05]


def test_shapiro(frame):
    row = hypothesis.shapiro_wilk(frame(a=[148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])).first()
    assert row["w"] == pytest.approx(0.788815, abs=1e-6) and row["p_value"] == pytest.approx(0.006704, abs=1e-6)


def test_shapiro_needs_spread(frame):
    rows = hypothesis.shapiro_wilk(frame(a=[1, 1, 1, 1], b=[1, 2], c=[])).collect()
    assert [r["w"] for r in rows] == [None, None, None]


def test_long_score_sums_match_enumeration():
    n = 50_000
    whole = math.fsum(dist.score_sum(i, i, n) for i in range(100, 30_001))
    assert dist.score_sum(100, 30_000, n) == pytest.approx(whole, rel=1e-11)


def test_mann_whitney_exact(frame):
    row = hypothesis.mann_whitney(frame(a=[19, 22, 16, 29, 24], b=[20, 11, 17, 12]), [("a", "b")]).first()
    assert row["u_statistic"] == 17 and row["p_value"] == pytest.approx(0.111111, abs=1e-6)


def test_levene_and_two_sample_t(frame):
    rows = {r["test"]: r for r in hypothesis.hypothesis_testing(frame(a=A, b=B), "a", "b").collect()}
    assert rows["levene_test"]["statistic"] == pytest.approx(8.461374, abs=1e-6)
    assert rows["levene_test"]["p_value"] == pytest.approx(0.009365, abs=1e-6)
    assert rows["two_sample_ttest"]["statistic"] == pytest.approx(-0.460023, abs=1e-6)
    assert rows["two_sample_ttest"]["p_value"] == pytest.approx(0.651008, abs=1e-6)


def test_one_sample_t(frame):
    row = hypothesis.hypothesis_testing(frame(a=[1, 2, 3, -1, 4]), "a").first()
    assert row["statistic"] == pytest.approx(2.092457, abs=1e-6) and row["p_value"] == pytest.approx(0.104540, abs=1e-6)


def test_suite_needs_two_columns(frame):
    with pytest.raises(ValueError):
        hypothesis.hypothesis_suite(frame(a=[1, 2]))


def test_adjusted_moments(frame):
    row = profile.numeric_profile(frame(a=[1, 2, 3, 10])).first()
    assert row["skewness"] == pytest.approx(1.763633, abs=1e-6) and row["kurtosis"] == pytest.approx(3.228, abs=1e-3)


def test_profile_of_edge_columns(frame):
    rows = {r["column"]: r for r in profile.numeric_profile(frame(one=[5], same=[2, 2, 2, 2], none=[None, None])).collect()}
    assert set(rows) == {"one", "same"}
    assert rows["one"]["std"] is None and rows["one"]["skewness"] is None
    assert rows["same"]["skewness"] == 0 and rows["same"]["kurtosis"] == 0


def test_spearman_with_ties(frame):
    rows = {(r["column1"], r["column2"]): r["r"] for r in correlation.spearman_matrix(frame(a=[1, 2, 2, 4], b=[3, 1, 5, 5])).collect()}
    assert rows["a", "b"] == pytest.approx(0.5)


def test_strong_correlations(frame):
    found = correlation.strong_correlations(frame(a=[1, 2, 3, 4, 5], b=[-2, -4, -6, -8, -10], c=[1, -1, 2, 0, 1])).collect()
    assert {(r["matrix"], r["direction"]) for r in found} == {(m, "negative") for m in ("pearson", "spearman", "kendall")}


def test_missing_and_blank_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "\t "), (3, " "), (4, ""), (5, None)], "id long, t string")
    masks = [r["t"] for r in clean.find_missing(df, "t", keep=["id"]).orderBy("id").collect()]
    assert masks == [False, True, True, True, True]
    assert clean.drop_missing(df, "t", only_null=True).count() == 4
    with pytest.raises(ValueError):
        clean.find_missing(df, "nope")


def test_fill_methods(spark, frame):
    df = frame(a=[1, 2, 2, None, float("nan"), 9])
    for method, value in (("mean", 3.5), ("median", 2), ("min", 1), ("max", 9), ("mode", 2)):
        assert [r["a"] for r in clean.fill_missing(df, method=method).collect()][3:5] == [value, value]
    assert clean.fill_missing(df, method="constant", value=7).collect()[3]["a"] == 7
    with pytest.raises(ValueError):
        clean.fill_missing(df, method="constant")
    with pytest.raises(ValueError):
        clean.fill_missing(df, method="guess")
    whole = spark.createDataFrame([(1,), (4,)], "n long")
    assert clean.fill_missing(whole, method="mean").dtypes == [("n", "bigint")]


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x"), (5, "y")], "id long, v string")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(clean.find_duplicates(df, "id")) == [2, 4]
    assert ids(clean.find_duplicates(df, "id", keep="last")) == [1, 3]
    assert ids(clean.find_duplicates(df, "id", keep=False)) == [1, 2, 3, 4]
    assert ids(clean.clean_duplicates(df, "id", keep=False)) == [5]
    with pytest.raises(ValueError):
        clean.find_duplicates(df, "id", keep="any")


def test_normalizing_edges(frame):
    df = frame(a=[3, 3, 3, None], b=[-1, -2, 0, 1])
    assert {r["a"] for r in normalize.normalize_data(df, "min_max").collect()} == {None}
    assert [r["b"] for r in normalize.normalize_data(df, "log").collect()] == [-math.inf, None, 0.0, pytest.approx(math.log(2))]
    spike = frame(a=[1, 1, 1, 1, 1, 9, -4])
    assert [r["a"] for r in normalize.normalize_data(spike, "robust").collect()] == [None] * 5 + [math.inf, -math.inf]
    with pytest.raises(ValueError):
        normalize.normalize_data(df, "magic")


def test_to_numeric_rules(spark):
    df = spark.createDataFrame([("1", "1.", "1d", "1", " 2 "), ("2", ".5", "2", "", "3")], "i string, f string, bad string, gap string, pad string")
    out = convert.to_numeric(df)
    assert out.dtypes == [("i", "bigint"), ("f", "double"), ("bad", "string"), ("gap", "double"), ("pad", "bigint")]
    with pytest.raises(ValueError):
        convert.to_numeric(df, errors="raise")


def test_datetime_formats(spark):
    assert convert.spark_pattern("%d/%m/%Y at %H:%M") == "dd'/'MM'/'yyyy' at 'HH':'mm"
    df = spark.createDataFrame([("03.02.2024",), ("2024-01-01",)], "d string")
    assert [r["d"] is None for r in convert.to_datetime(df, fmt="%d.%m.%Y").collect()] == [False, True]
    with pytest.raises(ValueError):
        convert.spark_pattern("%Q")


def test_narrowing_checks_both_ends(spark):
    df = spark.createDataFrame([(-(2**40), 5, 40_000, "a"), (1, 7, 3, "a"), (2, 8, 3, "a")], "low long, small long, mid long, t string")
    out = convert.narrow_types(df)
    assert [k for _, k in out.dtypes] == ["bigint", "smallint", "int", "string"]
    assert out.schema["t"].metadata == {"categorical": True}
    assert out.first()["low"] == -(2**40)


def test_one_hot_width_is_checked(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("v"))
    with pytest.raises(ValueError):
        convert.one_hot(df, max_width=10)
    assert len(convert.one_hot(df).columns) == 49
    assert convert.one_hot_vector(df).count() == 50


def test_sorting_puts_missing_last(spark, frame):
    df = frame(a=[2, None, float("nan"), 1])
    for up in (True, False):
        tail = [r["a"] for r in edit.sort_by(df, "a", up).collect()][2:]
        assert all(v is None or math.isnan(v) for v in tail)


def test_edits_that_do_not_fit_are_ignored(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "k long, v int")
    edits = spark.createDataFrame([(1, "v", "x"), (2, "v", "7")], "k long, column string, value string")
    assert sorted((r["k"], r["v"]) for r in edit.apply_edits(df, edits, "k", "v").collect()) == [(1, 10), (2, 7)]


def test_validation(spark, frame):
    bad = frame(x=[1, 2, float("nan"), math.inf], y=[1, 2, 3, 4], k=[0, 1, 2, 3])
    assert validate.validate(bad, "histogram", "x").first()["errors"] == ["NaN values present", "infinite values present"]
    assert validate.validate(bad, "line", "y", "k", order_by="k").first()["is_valid"]
    turned = frame(x=[1, 3, 2, 4], y=[1, 2, 3, 4], k=[0, 1, 2, 3])
    assert validate.order_breaks(turned, "x", "k").first()["breaks"] == 1
    assert validate.order_breaks(frame(x=[1, None], k=[0, 1]), "x", "k").first()["breaks"] == 1
    assert not validate.validate(bad, "spiral", "x").first()["is_valid"]
    assert "at least 2" in validate.validate(frame(x=[1]), "kde", "x").first()["errors"][0]
    grid = frame(r=[0, 0, 1], c=[0, 1, 0], z=[1, 2, 3])
    assert not validate.validate(grid, "surface", "r", "c", "z").first()["is_valid"]


def test_csv_types_and_delimiters(spark, tmp_path):
    (tmp_path / "t.csv").write_text("n;x;flag;d;t\n1;1.5;TRUE;2024-01-01;a\n2;NA;FALSE;2024-01-02;null\n")
    path = str(tmp_path / "t.csv")
    assert tables.detect_delimiter(spark, path) == ";"
    df = tables.read_delimited(spark, path)
    assert [k for _, k in df.dtypes] == ["bigint", "double", "boolean", "string", "string"]
    assert [tuple(r) for r in df.orderBy("n").collect()] == [(1, 1.5, True, "2024-01-01", "a"), (2, None, False, "2024-01-02", None)]


def test_json_files(spark, tmp_path):
    docs = {
        "records": '[\n {"a": 1, "b": "x"},\n {"a": 2}\n]', "split": '{"columns": ["b", "a"], "index": [0], "data": [["y", 3]]}',
        "index": '{"a": [4, 5], "b": ["z", null]}', "unknown": '{"a": 1}', "invalid JSON": '{"a": [1',
    }
    for name, text in docs.items():
        (tmp_path / f"{name.replace(' ', '_')}.json").write_text(text)
    found = {r["path"].rsplit("/", 1)[1]: r["orientation"] for r in tables.orientation_of(spark, str(tmp_path)).collect()}
    assert found == {f"{n.replace(' ', '_')}.json": n for n in docs} or {k.replace("%20", "_"): v for k, v in found.items()}
    rows = tables.read_json(spark, str(tmp_path), "a long, b string").orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1, "x"), (2, None), (3, "y"), (4, "z"), (5, None)]
