"""Running totals inside an array, built of SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from lodestat.llm.quality_rules import bind

_BLOCK = 256


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running `op` of an array, block by block, so that a long one costs little more than its length."""
    def inner(part: Column) -> Column:
        step = lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x)))
        return F.aggregate(F.slice(part, 2, _BLOCK * _BLOCK), F.slice(part, 1, 1), step)

    def joined(blocks: Column) -> Column:
        return bind(inner(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1))), lambda tops: F.flatten(F.transform(
            blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: op(F.get(tops, i - 1), x))))))

    def cut(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(whole) - 1, F.lit(0)), F.lit(_BLOCK))
        return bind(F.transform(starts, lambda at: inner(F.slice(whole, at + 1, _BLOCK))), joined)

    return bind(values, cut)
