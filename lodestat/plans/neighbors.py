"""Exact neighbour search by joining queries down a tree of cells.

Every cell is cut by rank: into up to sixteen parts of about equal counts, along
the dimension in which its points are widest apart, a value that fills a part
becoming a part of its own. So cells shrink whatever the number of dimensions,
the skew or the range. Every cell keeps its row count and the bounding box of its
points, so distances to a cell are exact bounds. All queries descend together,
one level per step: a step joins each query with the children of the cells it
still cares about and drops the children its bound excludes. A query therefore
only meets the points near it: a crowded cell is either taken by its count,
excluded, or split further. No step emits all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestat.functions.columns import number
from lodestat.plans.lineage import checkpoint
from lodestat.plans.sizing import SMALL_DISTINCT, double_array, fits_broadcast

_LEAF_POINTS = 32     # points aimed at per finest cell
_LEAF_LIMIT = 96      # more than that in one cell asks for another level
_FAN = 16             # parts of a cell at most
_STEPS_PER_CUT = 6    # levels between checkpoints of a descent


def _root() -> Column:
    return F.lit("")


@dataclass
class Tree:
    """Cells of all levels; level 0 is the root and holds no row."""

    dims: int
    levels: int
    cells: DataFrame        # level, cell, parent, n, lo, hi; a cell is its path, a hex digit per level
    counts: dict[int, int]  # cells per level
    points: DataFrame       # at, cell (finest), w, ...

    def level(self, i: int) -> DataFrame:
        cells = self.cells.where(F.col("level") == i).select(
            F.col("cell").alias("child"), F.col("parent").alias("cell"), "n", "lo", "hi")
        # small by the measured count
        return F.broadcast(cells) if self.counts[i] <= SMALL_DISTINCT // 10 else cells


def coordinates(df: DataFrame, columns: Sequence[str]) -> Column:
    """The columns as one array; rows with a missing one have NULL."""
    cols = [number(df, c) for c in columns]
    full = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
    # adding zero turns -0.0 into 0.0, so equal points compare equal
    return F.when(full, F.array(*[c + F.lit(0.0) for c in cols]))


def weighted_points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(at, w): distinct points with the number of rows at each."""
    at = df.select(coordinates(df, columns).alias("at")).where("at is not null")
    return at.groupBy("at").agg(F.count(F.lit(1)).alias("w"))


def build_tree(points: DataFrame, dims: int, like: Tree | None = None) -> Tree:
    """Tree over (at, w, ...) rows, written to the shared folder.

    Points are placed top down, or have their place from the tree of a larger
    set of points (`like`). Levels are aggregated bottom up.
    """
    if like is not None:
        levels, placed = like.levels, points
    else:
        levels, placed = _placed(points, dims)
    lows = [F.min(F.col("lo")[i]) for i in range(dims)]
    highs = [F.max(F.col("hi")[i]) for i in range(dims)]
    layer = placed.select("cell", F.col("w").alias("n"), F.col("at").alias("lo"), F.col("at").alias("hi"))
    written, pending = [], []
    for level in range(levels, 0, -1):
        layer = layer.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*lows).alias("lo"), F.array(*highs).alias("hi"))
        parent = F.substring("cell", 1, level - 1)
        layer = layer.select(F.lit(level).alias("level"), "cell", parent.alias("parent"), "n", "lo", "hi")
        pending.append(layer)
        if len(pending) == _STEPS_PER_CUT or level == 1:
            done = checkpoint(reduce(DataFrame.unionByName, pending))
            layer = done.where(F.col("level") == level)
            written.append(done)
            pending = []
        layer = layer.select(F.col("parent").alias("cell"), "n", "lo", "hi")
    cells = reduce(DataFrame.unionByName, written)
    counts = {r["level"]: r["count"] for r in cells.groupBy("level").count().collect()}
    return Tree(dims, levels, cells, {i: counts.get(i, 0) for i in range(1, levels + 1)}, placed)


def _cuts(points: DataFrame, dims: int) -> DataFrame:
    """(cell, n, dim, cuts): where each cell is cut, by ranks of the dimension that is widest."""
    shares = double_array([i / _FAN for i in range(1, _FAN)])
    value = [F.col("at")[i] for i in range(dims)]
    ways = F.array(*[F.struct(
        # between the outer cuts first, so that a lone far point does not decide
        F.nanvl(F.col(f"c{i}")[_FAN - 2] - F.col(f"c{i}")[0], F.lit(0.0)).alias("inner"),
        F.nanvl(F.col(f"hi{i}") - F.col(f"lo{i}"), F.lit(0.0)).alias("outer"),
        F.lit(i).alias("dim"), F.col(f"c{i}").alias("cuts")) for i in range(dims)])
    cells = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[
        a for i, v in enumerate(value)
        for a in (F.percentile_approx(v, shares, 1_000).alias(f"c{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"))])
    # a cell with few points is cut into fewer parts
    step = F.greatest(F.lit(1), F.floor(F.lit(_FAN) / F.ceil(F.col("n") / F.lit(_LEAF_POINTS))).cast("int"))
    return cells.select("cell", "n", F.array_max(ways).alias("way"), step.alias("step")).select(
        "cell", "n", F.col("way.dim").alias("dim"), F.filter("way.cuts", lambda c, i: (i + 1) % F.col("step") == 0).alias("cuts"))


def _placed(points: DataFrame, dims: int) -> tuple[int, DataFrame]:
    """(levels, points with the path of their finest cell), deep enough for small cells."""
    points = checkpoint(points.withColumn("cell", _root()))
    levels = 0
    while True:
        cuts = checkpoint(_cuts(points, dims))
        size = cuts.agg(F.count(F.lit(1)).alias("cells"), F.max("n").alias("fullest")).first()
        if levels and (size["fullest"] or 0) <= _LEAF_LIMIT:
            return levels, points
        split = cuts.where(F.col("n") > _LEAF_POINTS).select("cell", "dim", "cuts")
        if fits_broadcast(size["cells"], 8 * _FAN + levels):
            split = F.broadcast(split)
        own = F.get("at", F.col("dim"))
        # a cut that repeats is a value filling parts: it gets the first of them alone
        part = F.size(F.filter("cuts", lambda c: c < own)) + F.when(F.size(F.filter("cuts", lambda c: c == own)) > 1, 1).otherwise(0)
        digit = F.substring(F.lit("0123456789abcdef"), F.coalesce(part, F.lit(0)) + 1, F.lit(1))
        placed = points.join(split, "cell", "left").withColumn("cell", F.concat("cell", digit))
        points = checkpoint(placed.drop("dim", "cuts"))
        levels += 1


def _near(dims: int) -> Column:
    """Squared distance from a query to a box, 0 inside."""
    zero = F.lit(0.0)
    gaps = [
        F.greatest(F.col("lo")[i] - F.col("q")[i], F.col("q")[i] - F.col("hi")[i], zero) for i in range(dims)
    ]
    return reduce(add, [g * g for g in gaps])


def _far(dims: int) -> Column:
    """Squared distance from a query to the farthest corner of a box."""
    gaps = [
        F.greatest(F.col("q")[i] - F.col("lo")[i], F.col("hi")[i] - F.col("q")[i]) for i in range(dims)
    ]
    return reduce(add, [g * g for g in gaps])


def _squared(dims: int) -> Column:
    gaps = [F.col("q")[i] - F.col("at")[i] for i in range(dims)]
    return reduce(add, [g * g for g in gaps])


def _step(state: DataFrame, tree: Tree, level: int, how: str) -> DataFrame:
    joined = state.join(tree.level(level), "cell", how)
    return joined.withColumn("near", _near(tree.dims)).withColumn("far", _far(tree.dims))


def count_within(queries: DataFrame, tree: Tree, radius: float, enough: int) -> DataFrame:
    """(q, found): rows within `radius` of each query point.

    Exact below `enough`; from there on only known to reach it, and the query
    stops descending. `queries` has one row (q) per distinct point.
    """
    limit = F.lit(float(radius) * float(radius))
    mine = Window.partitionBy("q")
    done = F.concat(F.lit("-"), F.xxhash64("q").cast("string"))  # matches no cell, spreads evenly
    state = queries.select("q", F.lit(0).cast("long").alias("sure"), _root().alias("cell"))
    for level in range(1, tree.levels + 1):
        rows = _step(state, tree, level, "left")
        rows = rows.withColumn("sure", F.col("sure") + F.coalesce(
            F.sum(F.when(F.col("far") <= limit, F.col("n"))).over(mine), F.lit(0)))
        is_open = (F.col("near") <= limit) & (F.col("far") > limit) & (F.col("sure") < enough)
        rows = rows.withColumn("open", F.coalesce(is_open, F.lit(False)))
        first = F.row_number().over(mine.orderBy(F.desc("open")))
        state = rows.withColumn("first", first).where("open or first = 1").select(
            "q", "sure", F.when(F.col("open"), F.col("child")).otherwise(done).alias("cell"))
        if level % _STEPS_PER_CUT == 0 and level < tree.levels:
            state = checkpoint(state)
    near_points = state.join(tree.points.select("cell", "at", "w"), "cell", "left")
    hit = F.when(_squared(tree.dims) <= limit, F.col("w")).otherwise(0)
    return near_points.groupBy("q").agg((F.max("sure") + F.sum(hit)).alias("found"))


def nearest(queries: DataFrame, tree: Tree, k: int, order: Sequence[str] = ()) -> DataFrame:
    """(q, at, squared, take, and the other point columns): the k nearest rows.

    A point standing for w rows counts w times; `take` says how many of them are
    among the k. Ties in distance go by the `order` columns of the points.
    """
    mine = Window.partitionBy("q")
    by_far = mine.orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = queries.select("q", F.lit(math.inf).alias("bound"), _root().alias("cell"))
    for level in range(1, tree.levels + 1):
        rows = _step(state, tree, level, "inner").withColumn("reached", F.sum("n").over(by_far))
        kth = F.min(F.when(F.col("reached") >= k, F.col("far"))).over(mine)
        rows = rows.withColumn("bound", F.least("bound", kth))  # least skips NULL
        state = rows.where("near <= bound").select("q", "bound", F.col("child").alias("cell"))
        if level % _STEPS_PER_CUT == 0 and level < tree.levels:
            state = checkpoint(state)
    pairs = state.join(tree.points, "cell").drop("cell").withColumn("squared", _squared(tree.dims))
    by_distance = mine.orderBy("squared", *(order or ["at"]))
    # every row counts at least once, so row k is the last that can matter
    ranked = pairs.where("squared <= bound").withColumn("place", F.row_number().over(by_distance)).where(F.col("place") <= k)
    earlier = by_distance.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("w").over(earlier), F.lit(0))
    return (
        ranked.withColumn("take", F.least(F.col("w"), F.lit(k) - before)).where("take > 0")
        .drop("bound", "place", "w")
    )
