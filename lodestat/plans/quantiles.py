"""Exact, linearly interpolated quantiles at any number of rows and values.

`percentile` is exact but keeps every distinct value in memory, so it only sees
a bounded number of rows here. In larger tables a quantile sketch brackets each
quantile between two values, one aggregate counts the rows below and between
them and sketches those between again, and so on until few are left; only those
are looked at one by one. Every round keeps about one row in two thousand, all
columns together. Should a sketch miss, the distributed rank table gives the answer.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lodestat.plans.ranks import value_at, value_ranks
from lodestat.plans.sizing import PERCENTILE_ROWS, count_sizes, double_array

_ACCURACY = 10_000
_RESKETCH = 2_000  # steps of the sketch inside a bracket,
_SLACK = 2         # of which so many stay on each side of the place


def from_ranks(ranks: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., q) with q an array of quantiles, from `value_ranks` rows."""
    aggs = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("total") - 1)
        aggs += [
            value_at(F.floor(place)).alias(f"lo{i}"),
            value_at(F.ceil(place)).alias(f"hi{i}"),
            F.max(place - F.floor(place)).alias(f"f{i}"),
        ]
    parts = [_between(F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"f{i}")).cast("double") for i in range(len(probs))]
    grouped = ranks.groupBy(*by).agg(*aggs) if by else ranks.agg(*aggs)
    return grouped.select(*by, F.array(*parts).alias("q"))


def _between(low, high, share):
    return low + (high - low) * share


def quantiles(
    df: DataFrame, columns: Mapping[str, Column], probs: Sequence[float],
    extra: Sequence[Column] = (),
) -> tuple[dict[str, list[float] | None], dict]:
    """Quantiles of numeric expressions, plus other aggregates of the first pass.

    Returns ({name: [q, ...] or None without values}, {alias: `extra` result}).
    """
    exprs = {n: c.cast("double") for n, c in columns.items()}
    margin = 2.0 / _ACCURACY
    reach = double_array([x for p in probs for x in (max(0.0, p - margin), min(1.0, p + margin))])
    aggs = [
        a for i, e in enumerate(exprs.values()) for a in (
            F.count(e).alias(f"_n{i}"), F.percentile_approx(e, reach, _ACCURACY).alias(f"_b{i}"))
    ]
    first = df.agg(*aggs, *extra).first().asDict()
    counts = {n: first.pop(f"_n{i}") for i, n in enumerate(exprs)}
    brackets = {n: first.pop(f"_b{i}") for i, n in enumerate(exprs)}
    found: dict[str, list[float] | None] = {n: None for n in exprs}
    few = [n for n in exprs if 0 < counts[n] <= PERCENTILE_ROWS]
    many = [n for n in exprs if counts[n] > PERCENTILE_ROWS]
    if few:
        row = df.agg(*[F.percentile(exprs[n], double_array(probs)).alias(f"q{i}") for i, n in enumerate(few)]).first()
        found |= {n: row[i] for i, n in enumerate(few)}
    if many:
        found |= _bracketed(df, {n: exprs[n] for n in many}, probs, counts, brackets)
    return found, first


def _bracketed(df, exprs, probs, counts, brackets) -> dict[str, list[float]]:
    """Narrow the brackets of all quantiles together until few rows are inside.

    A pass counts the rows below and inside each bracket and, where many rows are
    inside, sketches them in the same aggregate, so the next bracket holds a small
    share of this one's rows. No pass shuffles values.
    """
    place = {(n, j): p * (counts[n] - 1) for n in exprs for j, p in enumerate(probs)}
    ends = {c: (math.floor(x), math.ceil(x)) for c, x in place.items()}
    open_ = {(n, j): tuple(brackets[n][2 * j:2 * j + 2]) for n, j in place}
    held = {(n, j): counts[n] for n, j in place}  # rows the bracket is a part of
    # the first bracket spans about 4 margins' share of the rows; a small one needs no sketch
    sketched = {c for c in open_ if counts[c[0]] * 4 / _ACCURACY > PERCENTILE_ROWS}
    shares = double_array(np.linspace(0, 1, _RESKETCH + 1))
    wanted, known, lost = [], {}, set()
    while open_:
        aggs = []
        for i, (c, (low, high)) in enumerate(open_.items()):
            value = exprs[c[0]]
            inside = (value >= low) & (value <= high)
            aggs += [
                F.count_if(value < low).alias(f"b{i}"), F.count_if(inside).alias(f"m{i}"),
            ]
            if c in sketched:
                aggs += [
                    F.count_if(value == low).alias(f"l{i}"), F.count_if(value == high).alias(f"h{i}"),
                    F.percentile_approx(F.when(inside, value), shares, _ACCURACY).alias(f"s{i}"),
                ]
        row = df.agg(*aggs).first()
        further = {}
        for i, (c, (low, high)) in enumerate(open_.items()):
            below, inside = row[f"b{i}"], row[f"m{i}"]
            if below > ends[c][0] or ends[c][1] >= below + inside:
                lost.add(c[0])  # the sketch missed
                continue
            if low == high:
                known[c] = (low, low)
            elif inside <= PERCENTILE_ROWS:
                wanted.append((*c, low, high, [(e - below + 0.5) / inside for e in ends[c]]))
            elif c not in sketched:
                further[c] = (low, high)
            elif all(e < below + row[f"l{i}"] or e >= below + inside - row[f"h{i}"] for e in ends[c]):
                known[c] = tuple(low if e < below + row[f"l{i}"] else high for e in ends[c])
            else:
                steps = row[f"s{i}"]
                first = math.floor((ends[c][0] - below) / inside * _RESKETCH - _SLACK)
                last = math.ceil((ends[c][1] - below) / inside * _RESKETCH + _SLACK)
                further[c] = (low if first <= 0 else steps[first], high if last >= _RESKETCH else steps[last])
                if further[c] == (low, high) and inside >= held[c]:
                    lost.add(c[0])  # values that the sketch does not tell apart
                held[c] = inside
        open_ = {c: b for c, b in further.items() if c[0] not in lost}
        sketched = set(open_)
    wanted = [w for w in wanted if w[0] not in lost]
    if wanted:
        ranges = [(exprs[n] >= low) & (exprs[n] <= high) for n, _, low, high, _ in wanted]
        held_values = df.where(reduce(or_, ranges)).select(*[
            F.when(inside, exprs[n]).alias(f"v{i}") for i, (inside, (n, *_)) in enumerate(zip(ranges, wanted))])
        # a share in the middle of one row's slot picks exactly that row
        row = held_values.agg(*[
            F.expr(f"percentile_disc({share!r}D) WITHIN GROUP (ORDER BY v{i})").alias(f"v{i}_{e}")
            for i, (*_, shares) in enumerate(wanted) for e, share in enumerate(shares)
        ]).first()
        for i, (n, j, *_) in enumerate(wanted):
            known[n, j] = (row[f"v{i}_0"], row[f"v{i}_1"])
    found = {}
    for n in exprs:
        if n in lost:
            found[n] = from_ranks(value_ranks(df, exprs[n]), probs).first()["q"]
        else:
            found[n] = [_between(*known[n, j], place[n, j] - math.floor(place[n, j])) for j in range(len(probs))]
    return found


def quantiles_by(df: DataFrame, value: Column, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by..., q): quantiles per group. A group may hold any share of the rows."""
    distinct = count_sizes(df, {"v": value})["v"]
    if distinct <= PERCENTILE_ROWS:
        return df.groupBy(*by).agg(F.percentile(value.cast("double"), double_array(probs)).alias("q"))
    return from_ranks(value_ranks(df, value, by), probs, by)
