"""Connected components of a table of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestat.llm.tables import store


def connected(links: DataFrame) -> DataFrame:
    """(id, component) of every id in `links` (a, b); component is the smallest id reachable.

    Each round hooks every id to its smallest neighbour, follows those hooks to
    their end by pointer doubling, and contracts the links to what remains
    between different ends: rounds grow with the logarithm of the ids. All
    tables stay distributed; the one-row-per-id side of each join is unique, so
    a much linked id only makes rows of the other side, which adaptive
    execution splits.
    """
    pairs = links.select("a", "b").where("a <> b")
    edges = store(pairs.union(pairs.select("b", "a")).distinct())
    labels = None
    while not edges.isEmpty():
        hooks = store(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("up")))
        while True:
            ends = hooks.select(F.col("a").alias("up"), F.col("up").alias("top"))
            further = store(hooks.join(ends, "up").select("a", F.col("top").alias("up"), (F.col("top") < F.col("up")).alias("moved")))
            hooks = further.select("a", "up")
            if further.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks.select(F.col("a").alias("id"), F.col("up").alias("component"))
        else:
            step = hooks.withColumnsRenamed({"a": "component"})
            labels = labels.join(step, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        top = hooks.withColumnsRenamed({"a": "b", "up": "ub"})
        edges = store(
            edges.join(hooks, "a").join(top, "b").where("up <> ub").select(F.col("up").alias("a"), F.col("ub").alias("b")).distinct())
    if labels is None:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    return labels
