"""Pearson, Spearman and Kendall correlation of every pair of columns.

Matrices are long tables (column1, column2, r). Each pair uses the rows where
both columns have a value.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestat.functions.columns import Columns, numeric_columns, pick, present, rows_from
from lodestat.plans.lineage import checkpoint
from lodestat.plans.ranks import BUCKET, with_bucket
from lodestat.plans.sizing import BUCKET_VALUES, ColumnSize, bucket_splits, column_sizes

GRID_SIDE = 1_024
_ROW = "_lodestat_row"
METHODS = ("pearson", "spearman", "kendall")


def _exprs(df: DataFrame, columns: Columns) -> dict[str, Column]:
    return {c: present(df, c).cast("double") for c in pick(df, columns, numeric_columns(df))}


def _mirror(pairs: DataFrame) -> DataFrame:
    """Both halves of a matrix from its upper one."""
    lower = pairs.where("column1 <> column2").select(
        F.col("column2").alias("column1"), F.col("column1").alias("column2"), "r")
    return pairs.unionByName(lower)


def _corr_rows(df: DataFrame, cells: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """(column1, column2, r) of all pairs from a single aggregate."""
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (_, _, a, b) in enumerate(cells)])
    return rows_from(row, [
        F.struct(F.lit(m).alias("column1"), F.lit(n).alias("column2"), F.col(f"r{i}").alias("r"))
        for i, (m, n, _, _) in enumerate(cells)
    ])


def pearson_matrix(df: DataFrame, columns: Columns = None) -> DataFrame:
    e = _exprs(df, columns)
    names = list(e)
    return _mirror(_corr_rows(df, [
        (a, b, e[a], e[b]) for i, a in enumerate(names) for b in names[i:]
    ]))


def rank_beside(column: str, other: str) -> str:
    """Name of the ranks of a column among the rows where the other one has a value too."""
    return f"_lodestat_rank_{column}_beside_{other}"


def with_ranks(df: DataFrame, names: list[str], sizes: dict[str, ColumnSize], gaps: Sequence[str] = ()) -> DataFrame:
    """The columns replaced by their average ranks among the rows that have a value.

    For every column of `gaps` each other column gets its ranks beside that one, too
    (see `rank_beside`). A column is still ranked once: next to the running count of
    all rows run those of the rows where a column of `gaps` has a value. A rank
    beside a column means nothing in rows that lack that column.

    Ranks of a column with few distinct values come from a broadcast table.
    Otherwise the rows are cut into rank-balanced buckets: a row's rank is the
    number of rows in earlier buckets plus its rank inside its own. A value that
    fills a bucket needs no rank inside it, so its rows are spread over salts, by
    an id that each row is written with; so are the rows without a value.
    """
    if not all(sizes[c].small for c in names):
        df = checkpoint(df.withColumn(_ROW, F.monotonically_increasing_id()))
    has = {g: f"_lodestat_has_{i}" for i, g in enumerate(gaps)}
    df = df.withColumns({flag: F.col(g).isNotNull().cast("long") for g, flag in has.items()})
    base = df
    for c in names:
        weights = {c: F.lit(1)} | {rank_beside(c, g): F.col(flag) for g, flag in has.items() if g != c}
        known = base.where(F.col(c).isNotNull())
        held = [F.sum(w).alias(f"_held{i}") for i, w in enumerate(weights.values())]
        places = range(len(weights))
        if sizes[c].small:
            earlier = Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)  # few values by measure
            ranks = known.groupBy(c).agg(*held).select(c, *[
                (F.coalesce(F.sum(f"_held{i}").over(earlier), F.lit(0)) + (F.col(f"_held{i}") + 1) / 2).alias(f"_rank{i}") for i in places])
            df = df.join(F.broadcast(ranks), c, "left").drop(c).withColumnsRenamed(  # size checked
                {f"_rank{i}": out for i, out in enumerate(weights)})
            continue
        splits = bucket_splits(sizes[c].edges, sizes[c].rows)
        earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
        offsets = with_bucket(known, F.col(c), splits).groupBy(BUCKET).agg(*held).select(BUCKET, *[
            x for i in places for x in (
                F.col(f"_held{i}"), F.coalesce(F.sum(f"_held{i}").over(earlier), F.lit(0)).alias(f"_before{i}"))])
        missing = F.col(c).isNull()
        alone = missing | F.col(BUCKET).isin(_lone(splits))
        cut = with_bucket(df, F.col(c), splits).withColumn(BUCKET, F.when(~missing, F.col(BUCKET))).withColumn(
            "_salt", F.when(alone, F.pmod(F.xxhash64(_ROW), F.lit(1_000))).otherwise(0))
        reached = Window.partitionBy(BUCKET, "_salt").orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        equal = Window.partitionBy(BUCKET, "_salt", c)
        placed = cut.withColumns({
            f"_inside{i}": F.sum(w).over(reached) - (F.sum(w).over(equal) - 1) / 2 for i, w in enumerate(weights.values())})
        own = [F.when(alone, (F.col(f"_held{i}") + 1) / 2).otherwise(F.col(f"_inside{i}")) for i in places]
        df = placed.join(F.broadcast(offsets), BUCKET, "left").withColumns({
            f"_rank{i}": F.when(~missing, F.col(f"_before{i}") + own[i]) for i in places
        }).drop(c, BUCKET, "_salt", *[f"_{k}{i}" for k in ("inside", "held", "before") for i in places]).withColumnsRenamed(
            {f"_rank{i}": out for i, out in enumerate(weights)})
    return df.drop(_ROW, *has.values())


def spearman_matrix(df: DataFrame, columns: Columns = None) -> DataFrame:
    """Pearson correlation of average ranks, over the rows a pair has in common.

    Every column is ranked once, whatever the number of pairs. With gaps a row
    carries one more rank per column and column with gaps.
    """
    e = _exprs(df, columns)
    names = list(e)
    sizes = column_sizes(df, e)
    gaps = [c for c in names if sizes[c].present < sizes[c].rows]
    ranked = with_ranks(df.select(*[x.alias(c) for c, x in e.items()]), names, sizes, gaps)

    def ranks(c: str, other: str) -> Column:
        return F.col(rank_beside(c, other) if other in gaps and other != c else c)

    return _mirror(_corr_rows(ranked, [
        (a, b, ranks(a, b), ranks(b, a)) for i, a in enumerate(names) for b in names[i:]
    ]))


def discordant_weight(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i * w_j over pairs with x_i < x_j and y_i > y_j.

    Rows are sorted by x, then pairs are told apart by the highest bit in which
    the ranks of their y differ: one stable sort and one running sum per bit.
    """
    order = np.lexsort((y, x))
    rank = np.unique(y[order], return_inverse=True)[1]
    weight = w[order].astype(float)
    total = 0.0
    for bit in reversed(range(int(rank.max()).bit_length())):
        prefix = rank >> (bit + 1)
        order = np.argsort(prefix, kind="stable")
        rank, weight, prefix = rank[order], weight[order], prefix[order]
        high = (rank >> bit) & 1
        running = np.cumsum(weight * high)
        starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        base = np.r_[0.0, running[starts[1:] - 1]]
        before = running - np.repeat(base, np.diff(np.r_[starts, len(rank)]))
        total += float(np.sum(weight * (1 - high) * before))
    return total


def _strip_discordant(pdf: pd.DataFrame) -> pd.DataFrame:
    found = discordant_weight(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy())
    return pd.DataFrame({"discordant": [found]})


def _grid_discordant(cells: pd.DataFrame) -> float:
    """Pairs whose x and y buckets both differ, from the counts per grid cell."""
    grid = np.zeros((cells["xb"].max() + 1, cells["yb"].max() + 1))
    np.add.at(grid, (cells["xb"].to_numpy(), cells["yb"].to_numpy()), cells["n"].to_numpy(dtype=float))
    above = np.zeros_like(grid)  # rows with a larger x bucket, this y bucket
    above[:-1] = grid[::-1].cumsum(axis=0)[::-1][1:]
    lower = np.zeros_like(grid)
    lower[:, 1:] = above.cumsum(axis=1)[:, :-1]
    return float((grid * lower).sum())


def _lone(splits: list[float]) -> list[int]:
    """Buckets that hold a single value: nothing inside them can be discordant."""
    return [i for i in range(len(splits) - 1) if splits[i + 1] == np.nextafter(splits[i], np.inf)]


def kendall_tau(df: DataFrame, x: Column, y: Column) -> float | None:
    """Tau-b of two columns.

    Rows are collapsed to distinct pairs with counts. Both columns are cut into
    rank-balanced buckets. Pairs of rows in different x and y buckets are counted
    from the grid of bucket counts (about GRID_SIDE x GRID_SIDE cells at most); those sharing a
    bucket by sorting inside that bucket. A value too frequent for a bucket sits
    in one of its own, where nothing is discordant, so no group grows with it.
    """
    rows = df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    # written once: sizes, ties, grid and strips all read it
    pairs = checkpoint(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    sizes = column_sizes(pairs, {"x": F.col("x"), "y": F.col("y")})
    most = GRID_SIDE * BUCKET_VALUES  # keeps the grid within GRID_SIDE x GRID_SIDE
    xs, ys = (bucket_splits(sizes[c].edges, min(sizes[c].rows, most)) for c in ("x", "y"))
    cut = with_bucket(pairs, F.col("x"), xs).withColumnRenamed("_bucket", "xb")
    cut = with_bucket(cut, F.col("y"), ys).withColumnRenamed("_bucket", "yb")

    def ties(*keys: str) -> Column:
        n = F.col("n").cast("double")
        return pairs.groupBy(*keys).agg(F.sum("n").alias("n")).agg(F.sum(n * (n - 1) / 2).alias("t"), F.sum(n).alias("rows"))

    n3 = ties("x", "y").first()
    n1, n2 = ties("x").first()["t"], ties("y").first()["t"]
    if not n3["rows"]:
        return None
    n0 = n3["rows"] * (n3["rows"] - 1) / 2
    grid = cut.groupBy("xb", "yb").agg(F.sum("n").alias("n")).toPandas()  # one row per grid cell
    strips = F.inline(F.array(
        F.struct(F.lit("x").alias("side"), F.col("xb").alias("strip"), F.col("x").alias("x"), F.col("y").alias("y"), F.col("n").alias("n")),
        F.struct(F.lit("y").alias("side"), F.col("yb").alias("strip"), F.col("xb").cast("double").alias("x"), F.col("y").alias("y"), F.col("n").alias("n")),
    ))
    alone = (F.col("side") == "x") & F.col("strip").isin(_lone(xs)) | (F.col("side") == "y") & F.col("strip").isin(_lone(ys))
    inside = (
        cut.select(strips).where(~alone)
        .groupBy("side", "strip").applyInPandas(_strip_discordant, "discordant double")
        .agg(F.coalesce(F.sum("discordant"), F.lit(0.0)).alias("d")).first()["d"]
    )
    bottom = (n0 - n1) * (n0 - n2)
    if bottom <= 0:
        return None
    return (n0 - n1 - n2 + n3["t"] - 2 * (inside + _grid_discordant(grid))) / bottom**0.5


def kendall_matrix(df: DataFrame, columns: Columns = None) -> DataFrame:
    e = _exprs(df, columns)
    names = list(e)
    ones = df.agg(*[(F.min(x) < F.max(x)).alias(f"v{i}") for i, x in enumerate(e.values())]).first()
    cells = [(c, c, 1.0 if ones[i] else None) for i, c in enumerate(names)]
    cells += [(a, b, kendall_tau(df, e[a], e[b])) for a, b in combinations(names, 2)]
    return _mirror(df.sparkSession.createDataFrame(cells, "column1 string, column2 string, r double"))


_MATRICES = {"pearson": pearson_matrix, "spearman": spearman_matrix, "kendall": kendall_matrix}


def correlation_matrix(df: DataFrame, method: str = "pearson", columns: Columns = None) -> DataFrame:
    if method not in _MATRICES:
        raise ValueError(f"Method '{method}' not supported.")
    return _MATRICES[method](df, columns)


def correlation_analysis(df: DataFrame, columns: Columns = None) -> DataFrame:
    """(matrix, column1, column2, r) of all three kinds."""
    parts = [m(df, columns).select(F.lit(n).alias("matrix"), "*") for n, m in _MATRICES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def strong_correlations(df: DataFrame, columns: Columns = None, above: float = 0.7) -> DataFrame:
    """(matrix, column1, column2, r, direction) of pairs with |r| above the limit."""
    names = pick(df, columns, numeric_columns(df))
    place = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
    return correlation_analysis(df, names).where(
        (place[F.col("column1")] < place[F.col("column2")]) & (F.abs("r") > above)
    ).withColumn("direction", F.when(F.col("r") > 0, "positive").otherwise("negative"))
