"""Statistical tests. The sums are Spark aggregates; the last step, a p-value per
column or pair, is plain arithmetic on a handful of rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lodestat.functions.columns import Columns, numeric_columns, pick, present, require, rows_from
from lodestat.functions.distributions import (
    f_tail, mann_whitney_p, score_sum, shapiro_p, shapiro_weights, t_two_sided,
)
from lodestat.plans.quantiles import quantiles
from lodestat.plans.ranks import running_totals, value_at, value_ranks, with_bucket
from lodestat.plans.sizing import column_sizes

ALPHA = 0.05
Pair = tuple[str, str]


def _exprs(df: DataFrame, names: Sequence[str]) -> dict:
    return {c: present(df, c).cast("double") for c in names}


@F.pandas_udf(T.DoubleType())
def _score(before: pd.Series, n: pd.Series, total: pd.Series) -> pd.Series:
    """Sum of the normal scores of the positions a value takes up."""
    return pd.Series([
        score_sum(b + 1, b + k, t) for b, k, t in zip(before.tolist(), n.tolist(), total.tolist())
    ])


def shapiro_wilk(df: DataFrame, columns: Columns = None) -> DataFrame:
    """(column, n, w, p_value, is_normal); p is unreliable above 5000 values.

    Needs 3 values and some spread, else w and p are NULL.
    """
    exprs = _exprs(df, pick(df, columns, numeric_columns(df)))
    sizes = column_sizes(df, exprs)
    out = []
    for name, e in exprs.items():
        ranks = value_ranks(df, e, size=sizes[name])
        first, last = F.lit(0), F.col("total") - 1
        mean = F.avg(e).alias("mean")
        centre = df.agg(mean).first()["mean"]
        x = F.col("value") - F.lit(centre)
        row = ranks.agg(
            F.max("total").alias("n"),
            F.sum(_score("before", "n", "total") * x).alias("scored"),
            F.sum(F.col("n") * x * x).alias("squares"),
            value_at(first).alias("x1"), value_at(first + 1).alias("x2"),
            value_at(last).alias("xn"), value_at(last - 1).alias("xm"),
        ).first()
        n, w, p = row["n"] or 0, None, None
        if n >= 3 and row["squares"] > 0:
            a_last, a_next, scale = shapiro_weights(n)
            m_last, m_next = (score_sum(i, i, n) for i in (n, n - 1))
            ends = [(a_last - scale * m_last, row["xn"] - row["x1"])]
            if n > 3:
                ends.append((a_next - scale * m_next, row["xm"] - row["x2"]))
            top = scale * row["scored"] + sum(a * gap for a, gap in ends)
            w = min(1.0, top * top / row["squares"])
            p = shapiro_p(w, n)
        out.append((name, n, w, p, None if p is None else p > ALPHA))
    return df.sparkSession.createDataFrame(
        out, "column string, n bigint, w double, p_value double, is_normal boolean")


def shape_measures(df: DataFrame, columns: Columns = None) -> DataFrame:
    """(column, skewness, kurtosis): population skewness and excess kurtosis."""
    exprs = _exprs(df, pick(df, columns, numeric_columns(df)))
    row = df.agg(*[
        a for i, e in enumerate(exprs.values()) for a in (F.skewness(e).alias(f"s{i}"), F.kurtosis(e).alias(f"k{i}"))
    ])
    return rows_from(row, [
        F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("skewness"), F.col(f"k{i}").alias("kurtosis"))
        for i, c in enumerate(exprs)
    ])


def quartiles(df: DataFrame, columns: Columns = None) -> DataFrame:
    """(column, q1, median, q3, iqr)."""
    exprs = _exprs(df, pick(df, columns, numeric_columns(df)))
    found, _ = quantiles(df, exprs, [0.25, 0.5, 0.75])
    return df.sparkSession.createDataFrame(
        [(c, *q, q[2] - q[0]) for c, q in found.items() if q],
        "column string, q1 double, median double, q3 double, iqr double")


def statistical_tests(df: DataFrame, columns: Columns = None) -> DataFrame:
    """Normality, shape and quartiles of each column in one row."""
    normality = shapiro_wilk(df, columns)
    parts = (shape_measures(df, columns), quartiles(df, columns))  # one row per column each
    for part in parts:
        normality = normality.join(F.broadcast(part), "column", "left")
    return normality


def _column_stats(df: DataFrame, names: Sequence[str], centred: bool = False) -> dict[str, dict]:
    """Moments of every column from one aggregate (plus the medians if asked)."""
    exprs = _exprs(df, names)
    medians = quantiles(df, exprs, [0.5])[0] if centred else {}
    aggs = []
    for i, (c, e) in enumerate(exprs.items()):
        aggs += [F.count(e).alias(f"n{i}"), F.avg(e).alias(f"mean{i}"), F.var_samp(e).alias(f"var{i}")]
        if medians.get(c):
            gap = F.abs(e - F.lit(medians[c][0]))
            aggs += [F.avg(gap).alias(f"gap{i}"), F.var_pop(gap).alias(f"gapvar{i}")]
    row = df.agg(*aggs).first().asDict()
    kinds = ("n", "mean", "var", "gap", "gapvar")
    return {c: {k: row.get(f"{k}{i}") for k in kinds} for i, c in enumerate(exprs)}


def _ratio(top: float, bottom: float) -> float | None:
    if bottom == 0:
        return None if top == 0 else math.copysign(math.inf, top)
    return top / bottom


def _one_sample(s: dict, mean: float) -> tuple:
    n = s["n"]
    t = _ratio(s["mean"] - mean, math.sqrt(s["var"] / n)) if n > 1 else None
    return n, t, t_two_sided(t, n - 1)


def _two_sample(a: dict, b: dict) -> tuple:
    n1, n2 = a["n"], b["n"]
    if min(n1, n2) < 1 or n1 + n2 < 3:
        return None, None
    squares = (n1 - 1) * (a["var"] or 0.0) + (n2 - 1) * (b["var"] or 0.0)
    pooled = squares / (n1 + n2 - 2)
    t = _ratio(a["mean"] - b["mean"], math.sqrt(pooled * (1 / n1 + 1 / n2)))
    return t, t_two_sided(t, n1 + n2 - 2)


def _levene(a: dict, b: dict) -> tuple:
    n1, n2 = a["n"], b["n"]
    if min(n1, n2) < 1 or n1 + n2 < 3:
        return None, None
    grand = (n1 * a["gap"] + n2 * b["gap"]) / (n1 + n2)
    between = n1 * (a["gap"] - grand) ** 2 + n2 * (b["gap"] - grand) ** 2
    f = _ratio((n1 + n2 - 2) * between, n1 * a["gapvar"] + n2 * b["gapvar"])
    return f, f_tail(f, 1, n1 + n2 - 2)


def one_sample_t(df: DataFrame, columns: Columns = None, mean: float = 0.0) -> DataFrame:
    """(column, n, t_statistic, p_value, rejected) against a given mean."""
    return _one_sample_rows(df, _column_stats(df, pick(df, columns, numeric_columns(df))), mean)


def _one_sample_rows(df: DataFrame, stats: dict[str, dict], mean: float = 0.0) -> DataFrame:
    rows = [(c, *_one_sample(s, mean)) for c, s in stats.items()]
    return df.sparkSession.createDataFrame(
        [(*r, None if r[3] is None else r[3] < ALPHA) for r in rows],
        "column string, n bigint, t_statistic double, p_value double, rejected boolean")


def _pairs(df: DataFrame, pairs: Sequence[Pair] | None) -> list[Pair]:
    """Given pairs, or every pair of numeric columns."""
    if pairs is None:
        names = numeric_columns(df)
        if len(names) < 2:
            raise ValueError("At least two numeric columns are needed.")
        return list(combinations(names, 2))
    pairs = [tuple(p) for p in pairs]
    require(df, [c for p in pairs for c in p])
    return pairs


def _names(pairs: Sequence[Pair]) -> list[str]:
    return list(dict.fromkeys(c for p in pairs for c in p))


def two_sample_t(df: DataFrame, pairs: Sequence[Pair] | None = None) -> DataFrame:
    """(column1, column2, n1, n2, t_statistic, p_value, rejected), equal variances."""
    pairs = _pairs(df, pairs)
    return _two_sample_rows(df, pairs, _column_stats(df, _names(pairs)))


def _two_sample_rows(df: DataFrame, pairs: Sequence[Pair], s: dict[str, dict]) -> DataFrame:
    rows = [(a, b, s[a]["n"], s[b]["n"], *_two_sample(s[a], s[b])) for a, b in pairs]
    return df.sparkSession.createDataFrame(
        [(*r, None if r[5] is None else r[5] < ALPHA) for r in rows],
        "column1 string, column2 string, n1 bigint, n2 bigint, t_statistic double, p_value double, rejected boolean")


def levene(df: DataFrame, pairs: Sequence[Pair] | None = None) -> DataFrame:
    """(column1, column2, statistic, p_value, variances_equal), median-centred."""
    pairs = _pairs(df, pairs)
    return _levene_rows(df, pairs, _column_stats(df, _names(pairs), centred=True))


def _levene_rows(df: DataFrame, pairs: Sequence[Pair], s: dict[str, dict]) -> DataFrame:
    rows = [(a, b, *_levene(s[a], s[b])) for a, b in pairs]
    return df.sparkSession.createDataFrame(
        [(*r, None if r[3] is None else r[3] > ALPHA) for r in rows],
        "column1 string, column2 string, statistic double, p_value double, variances_equal boolean")


def rank_sums(df: DataFrame, pairs: Sequence[Pair]) -> list[dict]:
    """n1, n2, u and ties for each pair of columns.

    All columns share one table of distinct values with a count per column, and
    one running total of these counts in the order of the values. U of a pair is
    then a sum of products: for each value of the first column, the rows of the
    second below it and half of those equal to it.
    """
    names = _names(pairs)
    exprs = _exprs(df, names)
    sizes = column_sizes(df, exprs)
    splits = np.unique([s for c in names for s in sizes[c].splits]).tolist()
    cells = F.inline(F.array(*[
        F.struct(F.lit(i).alias("c"), exprs[c].alias("value")) for i, c in enumerate(names)
    ]))
    counts = df.select(cells).where("value is not null").groupBy("value").agg(
        *[F.count_if(F.col("c") == i).alias(f"k{i}") for i in range(len(names))])
    kept = [f"k{i}" for i in range(len(names))]
    ranked = running_totals(with_bucket(counts, F.col("value"), splits), kept, ["value"])
    k = {c: F.col(f"k{i}").cast("double") for i, c in enumerate(names)}
    below = {c: F.col(f"before_k{i}").cast("double") for i, c in enumerate(names)}
    aggs = [F.sum(f"k{i}").alias(f"n{i}") for i in range(len(names))]
    for j, (a, b) in enumerate(pairs):
        tied = k[a] + k[b]
        aggs += [F.sum(k[a] * (below[b] + k[b] / 2)).alias(f"u{j}"), F.sum(tied * tied * tied - tied).alias(f"t{j}")]
    row = ranked.agg(*aggs).first()
    size = {c: row[f"n{i}"] or 0 for i, c in enumerate(names)}
    return [
        {"n1": size[a], "n2": size[b], "u": row[f"u{j}"], "ties": row[f"t{j}"]} for j, (a, b) in enumerate(pairs)
    ]


def mann_whitney(df: DataFrame, pairs: Sequence[Pair] | None = None) -> DataFrame:
    """(column1, column2, n1, n2, u_statistic, p_value, significant), two-sided.

    U belongs to the first column. p is exact when one sample has at most eight
    values and nothing is tied, else the corrected normal approximation.
    """
    pairs = _pairs(df, pairs)
    rows = []
    for pair, r in zip(pairs, rank_sums(df, pairs)):
        empty = not (r["n1"] and r["n2"])
        u = None if empty else r["u"]
        p = mann_whitney_p(u, r["n1"], r["n2"], r["ties"])
        rows.append((*pair, r["n1"], r["n2"], u, p, None if p is None else p < ALPHA))
    return df.sparkSession.createDataFrame(
        rows, "column1 string, column2 string, n1 bigint, n2 bigint, u_statistic double, p_value double, significant boolean")


_RESULT = "test string, column1 string, column2 string, statistic double, p_value double, decision boolean"


def _as_results(one: DataFrame | None, two: tuple[DataFrame, DataFrame, DataFrame] | None) -> DataFrame:
    parts = []
    if one is not None:
        parts.append(one.select(
            F.lit("one_sample_ttest").alias("test"), F.col("column").alias("column1"),
            F.lit(None).cast("string").alias("column2"), F.col("t_statistic").alias("statistic"),
            "p_value", F.col("rejected").alias("decision")))
    if two is not None:
        named = zip(two, ("two_sample_ttest", "mann_whitney_test", "levene_test"),
                    ("t_statistic", "u_statistic", "statistic"), ("rejected", "significant", "variances_equal"))
        parts += [
            part.select(F.lit(test).alias("test"), "column1", "column2", F.col(stat).alias("statistic"),
                        "p_value", F.col(verdict).alias("decision"))
            for part, test, stat, verdict in named
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hypothesis_testing(df: DataFrame, column1: str, column2: str | None = None) -> DataFrame:
    """(test, column1, column2, statistic, p_value, decision) rows: the one-sample
    t-test for one column, or t, Mann-Whitney and Levene for two.

    `decision`: hypothesis rejected, difference significant, variances equal.
    """
    if column2 is None:
        return _as_results(one_sample_t(df, column1), None)
    pair = [(column1, column2)]
    return _as_results(None, _pair_tests(df, pair, _column_stats(df, require(df, pair[0]), centred=True)))


def _pair_tests(df: DataFrame, pairs: Sequence[Pair], stats: dict[str, dict]) -> tuple:
    return _two_sample_rows(df, pairs, stats), mann_whitney(df, pairs), _levene_rows(df, pairs, stats)


def hypothesis_suite(df: DataFrame, columns: Columns = None) -> DataFrame:
    """The one-sample test of every numeric column and all tests of every pair.

    All moments come from one aggregate, whatever the number of pairs.
    """
    names = pick(df, columns, numeric_columns(df))
    if len(names) < 2:
        raise ValueError("At least two numeric columns are needed.")
    pairs = list(combinations(names, 2))
    stats = _column_stats(df, names, centred=True)
    return _as_results(_one_sample_rows(df, stats), _pair_tests(df, pairs, stats))
