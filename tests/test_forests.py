"""Trees against a plain one-machine tree, large paths against small ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import forests, models
from lodestat.operators.forests import Forest, Pruning, Settings, fit_trees, grow
from lodestat.sources import models as saved


class PlainTree:
    """Recursive splits: the largest fall of squared error or Gini impurity, halves between neighbouring values."""

    def __init__(self, x, y, classes=0, depth=None, split=2, leaf=1, level=0):
        self.at = None
        self.value = np.bincount(y.astype(int), minlength=classes) / len(y) if classes else np.array([y.mean()])
        if len(y) < max(split, 2) or len(set(y)) < 2 or level == depth:
            return
        best = None
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                if min(left.sum(), (~left).sum()) < leaf:
                    continue
                cost = sum(self.cost(y[side], classes) for side in (left, ~left))
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, f, cut, left)
        if best:
            _, f, cut, left = best
            above = x[x[:, f] > cut, f].min()
            self.at = (f, cut + (above - cut) / 2)
            self.sides = [PlainTree(x[m], y[m], classes, depth, split, leaf, level + 1) for m in (left, ~left)]

    @staticmethod
    def cost(y, classes):
        if classes:
            return len(y) - (np.bincount(y.astype(int), minlength=classes) ** 2).sum() / len(y)
        return ((y - y.mean()) ** 2).sum()

    def predict(self, row):
        return self.value if self.at is None else self.sides[int(row[self.at[0]] > self.at[1])].predict(row)


def sample(rows=150, dims=3, classes=0, seed=0, values=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, dims)) if values is None else rng.integers(0, values, (rows, dims)).astype(float)
    y = (x[:, 0] + x[:, 1] > 0) * 1.0 + (x[:, 2] > 0.5) if classes else np.round(x[:, 0] * 3 + np.sin(x[:, 1] * 2) + rng.normal(size=rows) / 5, 3)
    return x, y


def table(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in row], float(t)) for i, (row, t) in enumerate(zip(x, y))], "id long, x array<double>, y double")


def predictions(forest, points, **options):
    return np.array([r["values"] for r in forest.values(points, **options).orderBy("id").collect()])


@pytest.mark.parametrize("classes", [0, 3])
@pytest.mark.parametrize("limits", [{}, {"depth": 3}, {"split": 9}, {"leaf": 4}, {"depth": 5, "split": 6, "leaf": 2}])
def test_equals_a_plain_tree(classes, limits):
    for seed, values in ((1, None), (2, 6)):
        x, y = sample(classes=classes, seed=seed, values=values)
        names = {"depth": "max_depth", "split": "min_samples_split", "leaf": "min_samples_leaf"}
        nodes = grow(x, y, np.ones(len(y)), Settings(classes, **{names[k]: v for k, v in limits.items()}), np.uint64(5))
        plain = PlainTree(x, y, classes, **limits)
        got = nodes.value[forests.stops(nodes, x, forests.WHOLE)[0]]
        cost = lambda v: ((v[np.arange(len(y)), y.astype(int)] - 1) ** 2 if classes else (v[:, 0] - y) ** 2).sum()
        want = np.array([plain.predict(row) for row in x])
        # equal splits may be taken in any order, so where values tie the fit counts
        assert np.allclose(got, want, atol=1e-9) if values is None else cost(got) == pytest.approx(cost(want), rel=0.35, abs=1e-9)


def test_weights_count_as_rows():
    x, y = sample(80, seed=3)
    w = np.random.default_rng(1).integers(1, 4, 80).astype(float)
    own = grow(x, y, w, Settings(max_depth=4), np.uint64(1))
    many = np.repeat(np.arange(80), w.astype(int))
    again = grow(x[many], y[many], np.ones(len(many)), Settings(max_depth=4), np.uint64(1))
    assert np.allclose(own.value, again.value) and (own.feature == again.feature).all()


@pytest.mark.parametrize("classes", [0, 3])
def test_prunings_equal_separate_fits(classes):
    x, y = sample(200, classes=classes, seed=4)
    w = np.random.default_rng(2).integers(1, 3, 200).astype(float)
    deep = Settings(classes, subset=2)
    whole = grow(x, y, w, deep, np.uint64(7))
    for depth in (None, 0, 2, 5):
        for split in (2, 7, 30):
            own = grow(x, y, w, Settings(classes, subset=2, max_depth=depth, min_samples_split=split), np.uint64(7))
            assert np.allclose(
                whole.value[forests.stops(whole, x, [Pruning(depth, split)])[0]], own.value[forests.stops(own, x, forests.WHOLE)[0]])


@pytest.mark.parametrize("classes", [0, 3])
def test_large_path_equals_small_path(spark, monkeypatch, classes):
    """With few distinct values bins are exact, so nodes split by histograms must be those split in a task."""
    x, y = sample(600, classes=classes, seed=5, values=9)
    y = y + 1000 * (not classes)
    points = table(spark, x, y)
    settings = Settings(classes, trees=3, subset=2, min_samples_leaf=3)
    small = fit_trees(points, 3, settings)
    want = predictions(small, points)
    monkeypatch.setattr(forests, "PART_CELLS", 400)
    monkeypatch.setattr(forests, "HISTOGRAM_BYTES", 100_000)
    large = fit_trees(points, 3, settings)
    assert large.parts.count() > 4 and max(len(t.feature) for t in large.tops) > 2
    assert large.parts.agg(F.max(F.octet_length("rows"))).first()[0] <= 8 * 2 * 100
    assert np.allclose(predictions(large, points), want)
    monkeypatch.setattr(forests, "MODEL_BYTES", 0)
    monkeypatch.setattr(forests, "ROUTED_ROWS", 37)
    prunings = [Pruning(), Pruning(2), Pruning(None, 40), Pruning(6, 15)]
    for forest in (small, large):
        assert np.allclose(predictions(forest, points), want)
    met = predictions(large, points, prunings=prunings, prefixes=[1, 3])
    monkeypatch.setattr(forests, "MODEL_BYTES", 1 << 30)
    assert np.allclose(met, predictions(small, points, prunings=prunings, prefixes=[1, 3]))
    assert np.allclose(large.importances(), small.importances())


def test_draws_follow_a_poisson_law():
    drawn = Settings(bagged=True, trees=2).weights(1, np.arange(200_000))
    for k, share in enumerate((0.3679, 0.3679, 0.1839, 0.0613)):
        assert (drawn == k).mean() == pytest.approx(share, abs=0.005)
    assert (drawn != Settings(bagged=True, trees=2).weights(0, np.arange(200_000))).mean() > 0.5


def test_forest_does_not_depend_on_partitions(spark):
    x, y = sample(300, seed=6)
    points = table(spark, x, y)
    settings = Settings(trees=5, bagged=True)
    assert np.allclose(predictions(fit_trees(points, 3, settings), points), predictions(fit_trees(points.repartition(7), 3, settings), points))


def test_large_models_are_saved(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(forests, "PART_CELLS", 300)
    x, y = sample(400, classes=3, seed=8, values=12)
    rows = spark.createDataFrame(
        [(i, *map(float, row), f"class {int(t)}", 0.0) for i, (row, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, label string, x double")
    model = models.random_forest(rows, ["a", "b", "c"], "label", "classification", n_estimators=4)
    want = [(r.id, r.prediction) for r in model.transform(rows).orderBy("id").collect()]
    assert sum(p == r.label for (_, p), r in zip(want, rows.orderBy("id").collect())) > 320
    saved.save_model(model, str(tmp_path / "m"))
    monkeypatch.setattr(forests, "MODEL_BYTES", 0)
    assert [(r.id, r.prediction) for r in saved.score_saved(rows, str(tmp_path / "m")).orderBy("id").collect()] == want
    assert sum(r.importance for r in model.importances().collect()) == pytest.approx(1)


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_grid_equals_separate_fits(spark, task):
    x, y = sample(120, classes=3 * (task != "regression"), seed=9)
    rows = spark.createDataFrame([(i, *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    grid = {"n_estimators": [2, 5], "max_depth": [None, 2], "min_samples_split": [2, 12], "min_samples_leaf": [1, 5]}
    model, best, score, found = models.grid_search(rows, ["a", "b", "c"], "y", task, grid, cv=3, key="id")
    found = {r.parameters: r.score for r in found.collect()}
    assert len(found) == 16 and score == pytest.approx(max(found.values())) and found[str(sorted(best.items()))] == score
    from lodestat.operators.features import with_fold

    folded = with_fold(rows, "id", 3)
    for setting in ({"n_estimators": 2, "max_depth": 2, "min_samples_split": 12, "min_samples_leaf": 5}, {"n_estimators": 5, "max_depth": None, "min_samples_split": 12, "min_samples_leaf": 1}):
        own = []
        for fold in range(3):
            fitted = models.random_forest(folded.where(F.col("fold") != fold).drop("fold"), ["a", "b", "c"], "y", task, **setting)
            own.append(fitted.scores(folded.where(F.col("fold") == fold)).first()["r2" if task == "regression" else "accuracy"])
        assert found[str(sorted(setting.items()))] == pytest.approx(np.mean(own), abs=1e-9)


def test_bad_settings(spark):
    rows = spark.createDataFrame([(1.0, 2.0)], "a double, y double")
    for options in ({"param_grid": {"leaves": [1]}}, {"scoring": "nonsense"}, {"param_grid": {"max_depth": [31]}}):
        with pytest.raises(ValueError):
            models.grid_search(rows, ["a"], "y", **options)
    with pytest.raises(ValueError):
        models.decision_tree(rows.where("a > 5"), ["a"], "y")
    assert isinstance(fit_trees(table(spark, [[1.0]], [2.0]), 1, Settings()), Forest)


@pytest.mark.parametrize("classes", [0, 3])
def test_shared_features_equal_rows(spark, monkeypatch, classes):
    """A tree over sums per distinct features is the tree over the rows, whichever way the rows are met."""
    x, y = sample(900, classes=classes, seed=11, values=4)
    points = table(spark, x, y)
    settings = Settings(classes, trees=2, subset=2 if classes else None, min_samples_leaf=2)
    plain = grow(x, y, np.ones(len(y)), settings, settings.seeds(np.array([1]))[0])
    want = plain.value[forests.stops(plain, x, forests.WHOLE)[0]]
    ways = []
    for name in ("_fit_groups", "_fit_bundles"):
        own = getattr(forests, name)
        monkeypatch.setattr(forests, name, lambda *a, own=own, name=name: ways.append(name) or own(*a))
    small = fit_trees(points, 3, settings)
    monkeypatch.setattr(forests, "BROADCAST_BYTES", 0)
    grouped = fit_trees(points.repartition(5), 3, settings)
    assert "_fit_groups" in ways
    monkeypatch.setattr(forests, "SHARED_ROWS", 10_000)
    dealt = fit_trees(points.repartition(3), 3, settings)
    assert "_fit_bundles" in ways
    for forest in (small, grouped, dealt):
        both = predictions(forest, points, prefixes=[1, 2])
        assert np.allclose(both[:, -max(1, classes):] - both[:, :max(1, classes)], want)


@pytest.mark.parametrize("classes", [0, 3])
def test_models_are_scored_the_same_way(spark, monkeypatch, classes):
    """A table of cells, whole trees and tasks that hold some trees give the same values, also of gaps."""
    x, y = sample(300, classes=classes, seed=12, values=6)
    points = table(spark, x, y)
    forest = fit_trees(points, 3, Settings(classes, trees=5, bagged=True))
    asked = table(spark, np.vstack([x[:40], [[np.nan, 2.5, 9.0], [-1.0, np.nan, 0.5]]]), np.zeros(42))
    options = {"prunings": [Pruning(), Pruning(3, 9)], "prefixes": [2, 5]}
    cells = predictions(forest, asked, **options)
    monkeypatch.setattr(forests, "CELLS", 0)
    assert np.allclose(predictions(forest, asked, **options), cells)
    monkeypatch.setattr(forests, "MODEL_BYTES", forest.bytes - 1)
    monkeypatch.setattr(forests, "PART_CELLS", 80)
    assert np.allclose(predictions(forest, asked, **options), cells)


def test_grid_scores_every_row_once_and_by_its_number(spark):
    scored_rows = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def values(i):
        scored_rows.add(1)
        return [0.0, 1.0, 2.0, 1.0] if i % 4 else [1.0, 0.0, 0.0, 1.0]

    rows = spark.range(0, 40, 1, 2).select(
        F.lit(3).alias("fold"), (F.col("id") % 2).cast("double").alias("y"), F.when(F.col("id") % 4 == 0, 5).otherwise(1).cast("long").alias("n"), values("id").alias("values"))
    found = models._fold_scores(rows, 2, "accuracy", [1, 1])
    # ten rows of class 0 that stand for five each, ten more of it, twenty of class 1
    assert found == {3: {0: pytest.approx(70 / 80), 1: pytest.approx(10 / 80)}}
    assert scored_rows.value == 40


def test_two_classes_split_as_more_do():
    x, y = sample(400, classes=3, values=12)
    y = (y > 0).astype(float)
    for options in ({}, {"subset": 1}, {"min_samples_leaf": 3}):
        two, three = (grow(x, y, np.arange(400) % 3 * 1.0, Settings(classes=c, **options), np.uint64(7)) for c in (2, 3))
        assert (two.feature == three.feature).all() and (two.threshold == three.threshold).all()
        assert (two.value == three.value[:, :2]).all() and np.allclose(two.gain, three.gain)


def test_nodes_grown_apart_are_the_same(monkeypatch):
    for classes in (2, 3, 10):
        x, y = sample(900, dims=4, classes=3, seed=13, values=40)
        y = y % classes if classes < 10 else np.arange(900) % 10 * 1.0
        options = Settings(classes, subset=2, min_samples_leaf=2)
        whole = grow(x, y, np.arange(900) % 3 * 1.0, options, np.uint64(5))
        with monkeypatch.context() as m:
            m.setattr(forests, "BLOCK_ROWS", 50)
            apart = grow(x, y, np.arange(900) % 3 * 1.0, options, np.uint64(5))
        ends = [forests.stops(t, x, [Pruning(), Pruning(3), Pruning(None, 20)], start=np.zeros(900, int)) for t in (whole, apart)]
        for name in ("feature", "threshold", "rows", "gain", "value"):
            assert (getattr(whole, name)[ends[0]] == getattr(apart, name)[ends[1]]).all()
        assert len(whole.feature) == len(apart.feature)


@pytest.mark.parametrize("values", [None, 4])
def test_floats_of_two_parts_are_grown_in_one_task(spark, monkeypatch, values):
    """Such a table is dealt once to a task that grows some trees, not once for every tree."""
    x, y = sample(700, classes=3, seed=14, values=values)
    x = x.astype(np.float32).astype(float)
    points, settings = table(spark, x, y), Settings(3, trees=3, subset=2, min_samples_leaf=2)
    monkeypatch.setattr(forests, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(forests, "SHARED_ROWS", 10_000)
    monkeypatch.setattr(forests, "PART_CELLS", 1500)
    monkeypatch.setattr(forests, "_grow_tops", lambda *_: pytest.fail("grown in parts"))
    got = predictions(fit_trees(points.repartition(4), 3, settings), points, prefixes=[1, 2, 3])
    trees = [grow(x, y, np.ones(700), settings, seed) for seed in settings.seeds(np.arange(3))]
    want = np.cumsum([t.value[forests.stops(t, x, forests.WHOLE)[0]] for t in trees], axis=0)
    assert np.allclose(got, want.transpose(1, 0, 2).reshape(700, -1))


def test_parts_are_grown_for_some_trees_at_a_time(spark, monkeypatch):
    x, y = sample(500, classes=3, seed=15, values=9)
    points, settings = table(spark, x, y), Settings(3, trees=5, subset=2)
    monkeypatch.setattr(forests, "PART_CELLS", 300)
    want = predictions(fit_trees(points, 3, settings), points)
    monkeypatch.setattr(forests, "WAVE_TREES", 1 / spark.sparkContext.defaultParallelism)
    stored = []
    keep = forests._store
    monkeypatch.setattr(forests, "_store", lambda df: stored.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")) or keep(df))
    assert np.allclose(predictions(fit_trees(points, 3, settings), points), want)
    assert stored.count("true") == 5  # a write per tree, none of which keeps its shuffle files


def test_slim_trees_answer_the_same():
    x, y = sample(400, classes=3, seed=16)
    nodes = grow(x, y, np.ones(400), Settings(3, subset=2), np.uint64(3))
    for inner, prunings in ((False, forests.WHOLE), (True, [Pruning(2), Pruning(None, 30)])):
        slim = nodes.slim(inner)
        ends = forests.stops(nodes, x, prunings)
        assert (slim.values(ends) == nodes.values(ends)).all()
        again = forests.Nodes.unpacked(slim.packed(), 3)
        assert (again.values(ends) == nodes.values(ends)).all()
    assert len(nodes.slim(False).value) <= 4  # leaves of one class each, and a value for other nodes


def test_two_classes_of_shared_features_are_one_item():
    x, y = sample(700, classes=3, seed=17, values=9)
    y, settings = (np.arange(700) % 3 > 0) * 1.0, Settings(2, trees=2, bagged=True, subset=1, min_samples_leaf=2)
    order = np.lexsort((y, *x.T))
    x, y = x[order], y[order]
    for tree, part in enumerate(forests._grow_whole(x, y, np.arange(700), range(2), settings)):
        got = forests.Nodes.unpacked(part.to_pylist()[0], 2)
        want = grow(x, y, settings.weights(tree, np.arange(700)), settings, settings.seeds(np.array([tree]))[0])
        for name in ("feature", "threshold", "rows", "gain", "value", "left"):
            assert (getattr(got, name) == getattr(want, name)).all()


def test_numbers_too_large_to_pack_split_the_same(monkeypatch):
    x, y = sample(500, classes=3, seed=18, values=30)
    y = (y > 0) * 1.0
    for options in (Settings(2, subset=1), Settings(2, subset=2, min_samples_leaf=4), Settings(2)):
        packed = grow(x, y, np.arange(500) % 4 * 1.0, options, np.uint64(9))
        with monkeypatch.context() as m:
            m.setattr(forests, "_PACKED", 10)
            plain = grow(x, y, np.arange(500) % 4 * 1.0, options, np.uint64(9))
        for name in ("feature", "threshold", "rows", "gain", "value", "left"):
            assert (getattr(packed, name) == getattr(plain, name)).all()


def test_a_row_goes_down_once_for_all_prunings(monkeypatch):
    x, y = sample(300, classes=3, seed=19)
    prunings, trees = [Pruning(), Pruning(0), Pruning(3), Pruning(None, 25), Pruning(4, 9)], {}
    for tree in range(4):
        trees[tree] = grow(x, y, np.ones(300), Settings(3, subset=1), np.uint64(tree))
    want = [sum(trees[t].value[forests.stops(trees[t], x, prunings)] for t in range(n)) for n in (3, 1, 4)]
    met, own = [], forests.stops
    monkeypatch.setattr(forests, "stops", lambda nodes, x, p: met.append(len(p)) or own(nodes, x, p))
    got = forests._total(trees, x, prunings, [3, 1, 4])
    assert np.allclose(got, np.stack(want).transpose(2, 0, 1, 3).reshape(300, -1)) and met == [1] * 4
