"""Whitening against dense linear algebra."""

import math
import random

import numpy as np
import pytest

from lodestat.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", 1) for i, v in enumerate(vectors)], SCHEMA)


def steps(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def brute(vectors):
    """Distinct step vectors, their number and sums, eigenvalues and vectors of the covariance."""
    x = np.array(sorted({tuple(steps(v)) for v in vectors}), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x * n - sums).astype(float) / n
    values, own = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1], own[:, ::-1]


def check(found, vectors, count):
    n, sums, values, own = brute(vectors)
    by = {}
    for r in found:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(range(len(vectors)))
    signs = {}
    for i, rows in by.items():
        rows.sort(key=lambda r: r.component)
        assert [r.component for r in rows] == list(range(1, count + 1))
        x = np.array(steps(vectors[i]), dtype=object)
        exact = int(((x * n - sums) ** 2).sum())
        for r in rows:
            k = r.component - 1
            want = ((x * n - sums).astype(float) / n) @ own[:, k] / values[k] ** 0.5
            if abs(want) > 1e-3:
                assert signs.setdefault(k, np.sign(want) == np.sign(r.whitened)) == (np.sign(want) == np.sign(r.whitened))
            assert abs(abs(r.whitened) - abs(want)) < 1e-7
            assert r.n == n and r.deviation == (exact if exact < 2 ** 63 else None)
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9) and r.identity_error < 1e-9


@pytest.mark.parametrize("rows, dims, spread", [(400, 12, 1.0), (60, 80, 0.8), (3, 3, 1.0), (300, 90, 0.95)])
def test_equals_dense(spark, rows, dims, spread):
    rng = np.random.default_rng(rows)
    own = rng.normal(size=(rows, dims)) * spread ** np.arange(dims) + rng.normal(size=dims)
    vectors = [list(map(float, v)) for v in own] + [list(map(float, own[0]))] * 5  # copies count once
    check(wh.whiten(table(spark, vectors)).collect(), vectors, min(4, rows - 1, dims))


def test_equal_deviations_are_all_met(spark):
    """Three directions of the largest deviation, of which a single run would meet one."""
    vectors = []
    for k in range(100):
        for s in (1, -1):
            size = 8 if k in (3, 40, 77) else 1 + k / 100
            vectors.append([s * size if j == k else 0.0 for j in range(100)])
    found = [r for r in wh.whiten(table(spark, vectors)).collect() if r.vec_id == 0]
    values = brute(vectors)[2]
    assert values[2] == pytest.approx(values[0]) and values[3] < values[0] / 10
    assert [r.explained for r in found] == pytest.approx(list(values[:4] / values.sum()), rel=1e-6)
    assert found[0].identity_error < 1e-9


def test_edges(spark):
    vectors = [[1, 2], [1, 2], None, [1, None], [float("nan"), 1], [float("inf"), 1], [0.5], [], [-0.0, 3]]
    found = wh.whiten(table(spark, vectors)).collect()
    assert {r.vec_id for r in found} == {0, 1, 6, 7, 8} and {r.component for r in found} == {1, 2} and {r.n for r in found} == {4}
    assert wh.whiten(table(spark, [[1.0, 2.0]] * 9)).count() == 0
    assert wh.whiten(table(spark, [None])).count() == 0 and wh.whiten(table(spark, [])).count() == 0
    one = wh.whiten(table(spark, [[1, 5], [2, 5], [4, 5]])).collect()  # a dimension without variance
    assert {r.component for r in one} == {1}


def test_deviations_are_exact_or_null(spark):
    rng = random.Random(5)
    vectors = [[rng.uniform(-1, 1) * 10 ** rng.randint(0, 6) for _ in range(4)] for _ in range(40)]
    n, sums, _, _ = brute(vectors)
    found = {r.vec_id: r.deviation for r in wh.whiten(table(spark, vectors + [[3e38, 0, 0, 0]]), count=1).collect()}
    assert found[40] is None
    for values, many in ((vectors, n), (vectors, 1 << 45)):
        x = np.array([steps(v) for v in values])
        total = [int(s) for s in x.sum(axis=0)]
        exact = [sum((many * int(c) - s) ** 2 for c, s in zip(row, total)) for row in x]
        assert wh._deviation(x, many, total).to_pylist() == [v if v < 2 ** 63 else None for v in exact]
