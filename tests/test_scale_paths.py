"""The paths meant for large inputs, forced on small ones and compared with numpy
or brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestat.operators import anomaly, convert, correlation, edit, features, models, profile, series
from lodestat.plans import distinct, neighbors, quantiles, ranks, sizing, skew


@pytest.fixture
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 6_001
    data = pd.DataFrame({
        "id": np.arange(n), "a": rng.exponential(size=n), "b": rng.integers(0, 5, n).astype(float),
        "c": np.where(rng.random(n) < 0.34, 7.5, rng.normal(size=n) * 20),
    })
    return data, spark.createDataFrame(data).repartition(5)


@pytest.fixture
def small_limits(monkeypatch):
    monkeypatch.setattr(sizing, "SMALL_DISTINCT", 50)
    monkeypatch.setattr(sizing, "BUCKET_VALUES", 300)
    monkeypatch.setattr(correlation, "BUCKET_VALUES", 300)
    monkeypatch.setattr(quantiles, "PERCENTILE_ROWS", 400)


PROBS = [0, 0.1, 0.25, 0.5, 0.75, 0.999, 1]


def test_bracketed_quantiles(skewed, small_limits):
    data, df = skewed
    found, _ = quantiles.quantiles(df, {c: F.col(c) for c in "abc"}, PROBS)
    for c in "abc":
        assert np.allclose(found[c], data[c].quantile(PROBS), atol=1e-9)


def test_quantiles_narrow_their_brackets(spark, monkeypatch):
    """Coarse sketches take several rounds; no round counts distinct values."""
    monkeypatch.setattr(quantiles, "PERCENTILE_ROWS", 20)
    monkeypatch.setattr(quantiles, "_ACCURACY", 100)
    monkeypatch.setattr(quantiles, "_RESKETCH", 50)
    monkeypatch.setattr(quantiles, "value_ranks", lambda *_: pytest.fail("ranks of all values"))
    rng = np.random.default_rng(4)
    n = 20_000
    data = pd.DataFrame({
        "even": rng.normal(size=n), "steps": rng.integers(0, 3, n) * 1.5, "halves": np.arange(n) % 2 * 1.0,
        "hot": np.where(rng.random(n) < 0.4, 0.25, rng.random(n)), "far": np.r_[1e18, rng.exponential(size=n - 1)]})
    df = spark.createDataFrame(data).repartition(4)
    found, _ = quantiles.quantiles(df, {c: F.col(c) for c in data}, PROBS)
    for c in data:
        assert np.allclose(found[c], data[c].quantile(PROBS), rtol=1e-12)


def test_quantiles_from_ranks(skewed, small_limits):
    data, df = skewed
    q = quantiles.from_ranks(ranks.value_ranks(df, F.col("c")), PROBS).first()["q"]
    assert np.allclose(q, data["c"].quantile(PROBS))
    groups = quantiles.quantiles_by(df, F.col("a"), [0.5], ["b"]).collect()
    want = data.groupby("b")["a"].median()
    assert {r["b"]: pytest.approx(r["q"][0]) for r in groups} == want.to_dict()


def test_ranks(skewed, small_limits):
    data, df = skewed
    got = ranks.value_ranks(df, F.col("c")).select("value", ranks.average_rank().alias("r")).toPandas()
    want = pd.DataFrame({"value": data["c"], "w": data["c"].rank()}).drop_duplicates()
    both = got.merge(want, on="value")
    assert len(both) == len(want) == len(got) and np.allclose(both["r"], both["w"])


def test_correlations(skewed, small_limits):
    data, df = skewed
    df = df.select("a", "b", "c")
    for r in correlation.spearman_matrix(df).collect():
        assert r["r"] == pytest.approx(data[["a", "b", "c"]].corr("spearman").loc[r["column1"], r["column2"]])
    x, y = data["b"].to_numpy()[:1500], data["c"].to_numpy()[:1500]
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    tau = (dx * dy).sum() / np.sqrt(float((dx != 0).sum()) * (dy != 0).sum())
    part = df.sparkSession.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    assert correlation.kendall_tau(part, F.col("x"), F.col("y")) == pytest.approx(tau)


def test_label_encode_with_many_values(spark, small_limits):
    data = pd.DataFrame({"id": range(3000), "s": [f"common {'zx' if i % 3 == 0 else i * 7919 % 2001}" for i in range(3000)]})
    data.loc[::11, "s"] = None
    got = convert.label_encode(spark.createDataFrame(data)).orderBy("id").toPandas()["s"]
    codes = {v: i for i, v in enumerate(sorted(data["s"].dropna().unique()))}
    assert got.tolist() == [codes.get(v, len(codes)) for v in data["s"]]


def test_label_encode_of_values_with_a_long_common_prefix(spark, small_limits):
    data = pd.DataFrame({"n": [f"https://{'a' * 200}/{i * 7919 % 1999:06d}" for i in range(2500)] + ["0"]})
    df = spark.createDataFrame(data)
    codes = {v: i for i, v in enumerate(sorted(data["n"].unique()))}
    got = convert.label_encode(df.withColumn("text", F.col("n"))).select("text", "n").toPandas()
    assert sorted(got["n"]) == sorted(codes[v] for v in data["n"]) and (got["n"] == got["text"]).all()


def test_wide_keys_are_not_broadcast():
    assert sizing.fits_broadcast(100_000, 20) and not sizing.fits_broadcast(100_000, 20_000)


def test_hot_values_of_ranks_are_spread(spark, small_limits):
    """Equal rows get different salts, so no task gathers a hot value."""
    df = spark.createDataFrame(pd.DataFrame({"c": np.where(np.arange(4000) % 3 == 0, 7.5, np.arange(4000) / 9.0)}))
    ranked = correlation.with_ranks(df, ["c"], sizing.column_sizes(df, {"c": F.col("c")}))
    assert ranked.columns == ["c"]
    want = df.toPandas()["c"].rank().sort_values().tolist()
    assert sorted(r["c"] for r in ranked.collect()) == want


def test_ranks_with_gaps_in_several_columns(skewed, small_limits, monkeypatch):
    """One ranking per column; each pair counts the rows both columns have."""
    data = skewed[0][["a", "b", "c"]].copy()
    data["d"] = np.where(np.arange(len(data)) % 5 < 2, 1.0, 3.0)
    data["e"] = np.nan
    for step, c in ((7, "a"), (3, "c"), (4, "d")):
        data.loc[::step, c] = np.nan
    df = skewed[1].sparkSession.createDataFrame(data)
    cuts = []
    cut = correlation.with_bucket
    monkeypatch.setattr(correlation, "with_bucket", lambda *a: (cuts.append(1), cut(*a))[1])
    got = {(r["column1"], r["column2"]): r["r"] for r in correlation.spearman_matrix(df).collect()}
    assert len(got) == 25 and len(cuts) <= 2 * 5
    for a in data:
        for b in data:
            both = pd.DataFrame({"x": data[a], "y": data[b]}).dropna().rank()
            want = both["x"].corr(both["y"])
            assert got[a, b] is None or np.isnan(got[a, b]) if np.isnan(want) else got[a, b] == pytest.approx(want)


@pytest.mark.parametrize("values,room", [(10_000, 1 << 24), (40, 1 << 24), (10_000, 400), (0, 0)])
def test_distinct_counts_copy_no_rows(spark, monkeypatch, values, room):
    monkeypatch.setattr(distinct, "SET_VALUES", values)
    monkeypatch.setattr(distinct, "SET_BYTES", room)
    n = np.arange(3000)
    data = pd.DataFrame({
        "few": n % 7, "many": n * 31 % 2500, "zero": np.where(n % 2 == 0, 0.0, -0.0), "gappy": np.where(n % 3 == 0, np.nan, n % 50),
        "text": [f"{'long ' * 20}{i % 900}" for i in n], "hot": ["x" if i % 3 else f"y{i}" for i in n], "flag": n % 2 == 0})
    df = spark.createDataFrame(data).withColumn("none", F.lit(None).cast("string")).withColumn("list", F.array("few", F.col("flag").cast("long")))
    got = {r["column"]: r["unique_count"] for r in profile.unique_counts(df).collect()}
    assert got == {"few": 7, "many": 2500, "zero": 1, "gappy": 50, "text": 900, "hot": 1001, "flag": 2, "none": 0, "list": 14}
    empty = {r["unique_count"] for r in profile.unique_counts(df.where("few < 0")).collect()}
    assert empty == {0}


def test_deep_pages(spark, monkeypatch):
    monkeypatch.setattr(edit, "_NEAR_ROWS", 20)
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), F.lit("x").alias("n")).repartition(6)
    for number in (0, 1, 5, 99, 100, 142):
        got = [r["id"] for r in edit.page(df, "id", number, 7).collect()]
        assert got == list(range(1000))[number * 7:number * 7 + 7]
    down = edit.sort_by(df, "id", False)
    assert [r["id"] for r in edit.page(down, "id", 142, 7).collect()] == list(range(994, 1000))


def test_join_values_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(sizing, "SMALL_DISTINCT", 5)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.lit(3000))
    joined = skew.join_values(rows, table, "k", 50)
    assert joined.count() == 3000 and joined.where("n is null").count() == 0


def test_cells_shrink_in_many_dimensions_and_with_far_points(spark, monkeypatch):
    rng = np.random.default_rng(9)
    wide = rng.normal(size=(3000, 20))
    far = np.r_[[[1e18, 0.0]], rng.normal(size=(2999, 2))]
    flags = np.c_[rng.random(3000).round(3), (rng.random((3000, 3)) < 0.02) * 1.0, np.full(3000, np.inf)]
    for x in (wide, far, flags):
        points = spark.createDataFrame(pd.DataFrame({"at": np.unique(x, axis=0).tolist()})).withColumn("w", F.lit(1))
        tree = neighbors.build_tree(points, x.shape[1])
        fullest = tree.cells.where(F.col("level") == tree.levels).agg(F.max("n"), F.sum("n")).first()
        assert fullest[0] <= neighbors._LEAF_LIMIT and fullest[1] == points.count()
        assert tree.counts[1] <= neighbors._FAN
        per = tree.cells.groupBy("level", "parent").count().agg(F.max("count")).first()[0]
        assert per <= neighbors._FAN


def test_neighbours_with_a_far_point(spark):
    rng = np.random.default_rng(6)
    x = np.r_[[[1e18, 0.0]], rng.normal(size=(399, 2))]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    lonely = anomaly.knn_distance(df, ["a", "b"], 5, 0.5).toPandas().to_numpy()
    assert sorted(map(tuple, lonely)) == sorted(map(tuple, x[np.sort(far, 1)[:, :5].mean(1) > 0.5]))


@pytest.mark.parametrize("dims", [1, 2, 4, 20])
def test_neighbours_match_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(neighbors, "_LEAF_LIMIT", 16)
    monkeypatch.setattr(neighbors, "_LEAF_POINTS", 4)
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(300, dims)).round(3)
    x[:100] = x[:100] * 1e-3 + 2  # a third of the rows in a tiny cluster
    x[100:130] = x[100]           # and a group of copies
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(dims)]))
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    noise = anomaly.dbscan_noise(df, df.columns, 0.3, 4).toPandas().to_numpy()
    core = (far <= 0.3).sum(1) >= 4
    assert len(noise) == (~(far <= 0.3)[:, core].any(1)).sum()
    lonely = anomaly.knn_distance(df, df.columns, 5, 0.3).toPandas().to_numpy()
    assert sorted(map(tuple, lonely)) == sorted(map(tuple, x[np.sort(far, 1)[:, :5].mean(1) > 0.3]))


def test_knn_prediction(spark):
    rng = np.random.default_rng(3)
    train = pd.DataFrame({"id": range(200), "x": np.tile(rng.normal(size=100), 2), "z": np.tile(rng.normal(size=100), 2), "y": rng.normal(size=200)})
    test = pd.DataFrame({"x": rng.normal(size=40), "z": rng.normal(size=40)})
    got = models.knn_predict(spark.createDataFrame(train), spark.createDataFrame(test), ["x", "z"], "y", "id", n_neighbors=3).toPandas()
    shift, width = train[["x", "z"]].mean(), train[["x", "z"]].std(ddof=0)
    a, b = ((t[["x", "z"]] - shift) / width for t in (train, got))
    for i in range(len(got)):
        d2 = ((a - b.iloc[i]) ** 2).sum(axis=1).round(12)
        near = np.lexsort((train["id"], d2))[:3]
        assert got["prediction"].iloc[i] == pytest.approx(train["y"].iloc[near].mean(), abs=1e-9)


def test_planted_outliers(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"id": range(1000), "x": rng.normal(size=1000), "y": rng.normal(size=1000)})
    data.loc[:4, ["x", "y"]] = [[9, 9], [-9, 9], [9, -9], [10, 0], [0, -10]]
    df = spark.createDataFrame(data)
    found = {r["id"] for r in anomaly.isolation_forest(df, ["x", "y"], key="id").collect()}
    assert {0, 1, 2, 3, 4} <= found and len(found) < 400
    again = {r["id"] for r in anomaly.isolation_forest(df.repartition(3), ["x", "y"], key="id").collect()}
    assert found == again
    flagged = {r["id"] for r in anomaly.one_class_svm(df, ["x", "y"]).collect()}
    assert len(flagged) == 500 and {0, 1, 2, 3, 4} <= flagged
    rare = {r["id"] for r in anomaly.one_class_svm(df, ["x", "y"], nu=0.05).collect()}
    assert len(rare) == 50
    with pytest.raises(ValueError):
        anomaly.detect_anomalies(df, "nope")


@pytest.mark.parametrize("period", [4, 7])
def test_decompose_in_stretches(spark, monkeypatch, period):
    monkeypatch.setattr(series, "_CHUNK", 10)
    rng = np.random.default_rng(2)
    n = 150
    y = pd.Series(rng.normal(size=n) + np.arange(n) * 0.1)
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(n), "v": y}))
    got = series.decompose(df, "v", "t", period).orderBy("t").toPandas()
    weights = np.ones(period) if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5]
    trend = np.full(n, np.nan)
    half = period // 2
    trend[half:n - half] = np.convolve(y, weights / period, "valid")
    phase = pd.Series(y - trend).groupby(np.arange(n) % period).mean()
    want = y - trend - (phase - phase.mean()).to_numpy()[np.arange(n) % period]
    assert np.allclose(got["residual"].astype(float), want, equal_nan=True)


def test_split_sizes_are_exact(spark):
    for n in (1, 5, 100, 1001):
        df = spark.range(n)
        train, test = features.split(df, "id")
        assert test.count() == -(-n // 5) and train.count() == n - -(-n // 5)
    marked = features.mark_test(spark.range(1000).withColumn("s", F.when(F.col("id") % 3 > 0, "big")), "id", stratify="s")
    counts = {(r["s"], r["is_test"]): r["count"] for r in marked.groupBy("s", "is_test").count().collect()}
    assert counts == {("big", True): 133, ("big", False): 533, (None, True): 67, (None, False): 267}


def test_patterns_let_through_what_a_layout_parses(spark):
    """Every text that a layout writes or parses matches its pattern, and other texts are not parsed at all."""
    from lodestat.operators import convert

    times = spark.sql("SELECT explode(array(timestamp'2024-01-02 03:04:05.678901', timestamp'1999-12-31 23:59:59')) AS t")
    texts = times.select(F.explode(F.array(*[F.date_format("t", p) for p in convert.DATE_LAYOUTS])).alias("s")).unionByName(
        spark.createDataFrame([("2024-1-2",), ("+12024-01-02",), ("jan 3, 2024",), ("2024-01-02 03:04:05.1",), ("3/4/2024 5:06 pm",), (" 2024",), ("no date 7",)], "s string"))
    matched = texts.agg(*[
        F.count_if(F.try_to_timestamp("s", F.lit(p)).isNotNull() & ~F.col("s").rlike(convert._could_be(p))).alias(f"p{i}")
        for i, p in enumerate(convert.DATE_LAYOUTS)]).first()
    assert not any(matched)
    assert texts.where("s LIKE 'no date%'").select(*[F.col("s").rlike(convert._could_be(p)) for p in convert.DATE_LAYOUTS]).first().count(True) == 0


def test_one_class_svm_looks_at_equal_points_once(spark, monkeypatch):
    from lodestat.operators import anomaly

    seen = []
    own = anomaly.vector_sum
    monkeypatch.setattr(anomaly, "vector_sum", lambda df, *a: seen.append(df.count()) or own(df, *a))
    rows = spark.range(300).selectExpr("id", "double(id % 5) AS x", "double(id % 3) AS y")
    anomaly.one_class_svm(rows, ["x", "y"], steps=1)
    assert set(seen) == {15}
