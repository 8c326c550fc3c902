"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of their centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestat.llm.tables import store

COMPONENTS = 4
SCALE = 256
_CLOSE = 1e-14       # residual of a component, of the largest deviation, at which it is taken
_NOTHING = 1e-12     # a deviation below this share of the largest is none
_BLOCK = 1 << 19     # entries packed into a row
_LONG = (1 << 63) - 1


def _whole(vector: Column) -> Column:
    """Neither NULL nor with a NULL or non-finite entry."""
    return F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))


def steps(vector: Column) -> Column:
    """The entries in steps of 1 / SCALE, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def _rows(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows that stay, with `x`, all as long as the longest, and that length."""
    kept = vectors.where(_whole(F.col(column))).withColumn("x", steps(F.col(column)))
    short, dims = kept.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if dims and short < dims:
        kept = kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    return kept, dims or 0


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dims)


def _pack(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Vectors in blocks, in the narrowest integers that hold them."""
    for batch in batches:
        x = _matrix(batch.column("x"), dims)
        for at in range(0, len(x), max(1, _BLOCK // dims)):
            part = x[at:at + max(1, _BLOCK // dims)]
            kind = next(k for k in ("i2", "i4", "i8") if np.iinfo(k).min <= part.min() and part.max() <= np.iinfo(k).max)
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([part.astype(kind).tobytes()], pa.binary())], ["kind", "data"])


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data")):
            yield np.frombuffer(data.as_buffer(), dtype=kind).reshape(-1, dims)


def _count(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Exact sums per dimension and, last, the number of rows."""
    total = np.zeros(dims + 1, dtype=object)
    for x in _blocks(batches, dims):
        high = (x.astype(np.int64) >> 32).sum(axis=0).astype(object)
        total[:dims] += (high << 32) + (x.astype(np.int64) & 0xFFFFFFFF).sum(axis=0).astype(object)
        total[dims] += len(x)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(dims + 1), pa.int32()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], ["place", "x"])


def _fold(batches: Iterator[pa.RecordBatch], mean: np.ndarray, work: Callable[[np.ndarray], np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size)
    for x in _blocks(batches, len(mean)):
        total += work(x - mean)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["place", "x"])


def _summed(parts: DataFrame) -> list:
    """Sums by place; their number is that of dimensions and steps, not of rows."""
    return [r["x"] for r in parts.groupBy("place").agg(F.sum("x").alias("x")).orderBy("place").collect()]


class _Rows:
    """The centred rows of the fit, as an operator on small vectors."""

    def __init__(self, blocks: DataFrame, dims: int):
        self.blocks, self.dims = blocks, dims
        sums = [int(v) for v in _summed(blocks.mapInArrow(partial(_count, dims=dims), "place int, x decimal(38,0)"))]
        self.sums, self.n = sums[:dims], sums[dims]
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(dims)

    def total(self, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        run = partial(_fold, mean=self.mean, work=work, size=size)
        return np.array(_summed(self.blocks.mapInArrow(run, "place int, x double")))

    def products(self, w: np.ndarray, left: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Of p = Xw: its squared length, its products with the columns of X left, and X'p."""
        def work(x: np.ndarray) -> np.ndarray:
            p = x @ w
            return np.concatenate([[p @ p], p @ (x @ left), p @ x])

        many = left.shape[1]
        sums = self.total(work, 1 + many + self.dims)
        return float(sums[0]), sums[1:1 + many], sums[1 + many:]


def _orthogonal(v: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    for _ in range(2):
        for basis in bases:
            v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(rows: _Rows, wanted: int, against: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, bool]:
    """The largest singular values and right vectors of X apart from `against`, and whether all directions were met.

    X V = U B and X'U = V B' + (rest), with B upper bidiagonal. A left vector is
    kept as the w whose Xw it is, so nothing as long as the table is held: every
    step is one pass in which tasks multiply their rows by w and the result by
    their rows again. Both sides are orthogonalised against all earlier vectors:
    w first by the products X'U already known, then by those measured in the
    pass. Where the space closes, the next direction is drawn anew.
    """
    dims = rows.dims
    rng = np.random.default_rng(seed)
    right, left, back = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims, 0))
    diagonal, above = [], []
    v = _orthogonal(rng.normal(size=dims), against)
    while True:
        v = v / np.linalg.norm(v)
        w = v - left @ (back.T @ v)
        squares, along, g = rows.products(w, left)
        w, g = w - left @ along, g - back @ along
        alpha = max(squares - along @ along, 0.0) ** 0.5
        scale = max([alpha, *diagonal, *above])
        right = np.column_stack([right, v])
        if alpha <= _CLOSE * scale:
            alpha, w, g = 0.0, np.zeros(dims), np.zeros(dims)
        else:
            w, g = w / alpha, g / alpha
        left, back = np.column_stack([left, w]), np.column_stack([back, g])
        diagonal.append(alpha)
        rest = _orthogonal(g, right, against)
        beta = float(np.linalg.norm(rest))
        p, sigma, q = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1))
        if right.shape[1] + against.shape[1] == dims:
            return sigma[:wanted], (right @ q.T)[:, :wanted], True
        if beta <= _CLOSE * scale:
            beta, rest = 0.0, _orthogonal(rng.normal(size=dims), right, against)
        elif len(sigma) > wanted and (beta * np.abs(p[-1, :wanted]) <= _CLOSE * sigma[0]).all():
            return sigma[:wanted], (right @ q.T)[:, :wanted], False
        above.append(beta)
        v = rest


def components(rows: _Rows, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest singular values above none and their vectors, signed by the largest entry.

    A run sees one vector of each value only. So runs apart from what is found
    follow, until one meets no larger value or no direction is left.
    """
    values, vectors = np.zeros(0), np.zeros((rows.dims, 0))
    while vectors.shape[1] < rows.dims:
        wanted = min(count - len(values) if len(values) < count else 1, rows.dims - vectors.shape[1])
        sigma, found, all_met = bidiagonalise(rows, wanted, vectors, seed=len(values))
        news = len(values) < count or sigma[0] > np.sort(values)[-count] * (1 + _NOTHING)
        values, vectors = np.append(values, sigma), np.column_stack([vectors, found])
        if all_met or not news:
            break
    order = np.argsort(-values, kind="stable")[:count]
    order = order[values[order] > _NOTHING * values.max(initial=0.0)]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if rows.dims else np.ones(0)
    return values[order], (vectors * signs)[:, order]


@dataclass(frozen=True)
class Fit:
    """What a whitening needs: of the distinct vectors their number, sums, components and deviations."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(x: DataFrame, dims: int, count: int = COMPONENTS) -> Fit:
    """A whitening of `x` (x array<long> of `dims` entries), each distinct vector once."""
    blocks = store(x.select("x").distinct().mapInArrow(partial(_pack, dims=dims), "kind string, data binary"))
    rows = _Rows(blocks, dims)
    if rows.n < 2:
        return Fit(rows.n, rows.sums, np.zeros((dims, 0)), np.zeros(0), np.zeros(0), 0.0)
    trace = rows.total(lambda c: np.array([np.einsum("ij,ij->", c, c)]), 1)[0] / rows.n
    sigma, vectors = components(rows, count)
    deviations = sigma / rows.n ** 0.5

    def squares(c: np.ndarray) -> np.ndarray:
        own = c @ (vectors / deviations)
        return (own.T @ own).ravel()

    many = len(sigma)
    left = rows.total(squares, many * many).reshape(many, many) / rows.n - np.eye(many)
    return Fit(rows.n, rows.sums, vectors, deviations, deviations ** 2 / trace, float(np.abs(left).max(initial=0.0)))


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum of (n x - sum) ** 2 of each row, exactly; NULL beyond a long."""
    if n * int(np.abs(x).max(initial=0)) >= 1 << 52:
        exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
        return pa.array([v if v <= _LONG else None for v in exact], pa.int64())
    apart = x * n - np.array(sums, dtype=np.int64)
    rough = (apart.astype(float) ** 2).sum(axis=1)
    exact = np.where(rough[:, None] < 2.0 ** 63.5, apart, 0).astype(np.uint64)  # products modulo 2 ** 64
    value = (exact * exact).sum(axis=1, dtype=np.uint64)
    fits = (rough < 2.0 ** 63.5) & (value <= _LONG)
    return pa.array(np.where(fits, value, 0).astype(np.int64), mask=~fits)


def _apply(batches: Iterator[pa.RecordBatch], made: Fit, dims: int) -> Iterator[pa.RecordBatch]:
    many = len(made.deviations)
    mean = np.array([s / made.n for s in made.sums])
    for batch in batches:
        x = _matrix(batch.column("x"), dims)
        white = (x - mean) @ (made.vectors / made.deviations)
        own = pa.array(np.repeat(np.arange(len(x)), many))
        yield pa.RecordBatch.from_arrays([
            batch.column("vec_id").take(own), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
            pa.array(np.full(len(own), made.n)), _deviation(x, made.n, made.sums).take(own), pa.array(white.ravel()),
            pa.array(np.tile(made.explained, len(x))), pa.array(np.full(len(own), made.identity_error))],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, column: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Whitened embeddings: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is NULL or holds a NULL or non-finite entry go. Entries
    become whole steps of 1 / 256, and the fit takes each distinct vector of
    steps once: `n` of them, with exact sums S. Components are the eigenvectors
    of their covariance by falling eigenvalue, from a bidiagonalisation of the
    centred rows; those without variance are left out, so up to `count` rows are
    returned per row, and none where all vectors are equal. `whitened` is the
    centred row along the component over its deviation, `explained` the
    eigenvalue's share of the trace, `deviation` the exact sum of (n x - S) ** 2,
    NULL beyond a long, and `identity_error` the largest entry of the whitened
    covariance less the identity.

    Vectors shorter than the longest are filled up with zeros. Rows keep their
    vec_id, repeated or NULL; repeated rows are each returned; an empty table has
    no result. Other columns are ignored. The driver holds vectors of one entry
    per dimension, three for each step, and no covariance.
    """
    rows, dims = _rows(vectors.select("vec_id", column), column)
    rows = rows.select("vec_id", "x")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    made = fit(rows, dims, count)
    return rows.mapInArrow(partial(_apply, made=made, dims=dims), schema)
