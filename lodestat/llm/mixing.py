"""Mixing sources to target weights by the cube method."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestat.llm.quality_rules import spaced_words
from lodestat.llm.tables import store

WEIGHTS = (1.0, 2.0, 3.0)  # of the sources in order, repeating
MOST = 3                   # times a document, and so a source, is taken at most
_UNITS = 2_000             # documents of a group on the first level
_FAN = 500                 # groups whose rest meets on the next level
_LANDING = 12              # units of a source that land together
_NEAR = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, no, source_size, docs, target) of each source of `sizes` (source, size).

    Sources are numbered by code point, NULL last, and weighed in turn. They
    share the sum of all sizes by weight; a target stops at `most` times its
    source's size and the excess is shared again until none is above. Each
    round is one aggregate over the table of sources.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ordered = totals.orderBy(F.col("source").asc_nulls_last())
    numbered = ordered.rdd.zipWithIndex().map(lambda r: (r[0][0], r[0][1], r[0][2], r[1]))
    table = spark.createDataFrame(numbered, "source string, source_size long, docs long, no long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    table = store(table.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)))
    level, rest = 0.0, -1
    while True:
        capped = F.lit(level) * F.col("weight") >= F.col("cap")
        row = table.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("cap"))).alias("full"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.count(F.when(~capped, 1)).alias("rest")).first()
        if not row["rest"] or row["rest"] == rest:
            break
        level, rest = (row["all"] - (row["full"] or 0.0)) / row["open"], row["rest"]
    return table.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("weight", "cap")


def _step(chance: list[float], size: list[float], at: list[int], draw) -> None:
    """Move the chances of three units along the null space of both totals until one is 0 or 1."""
    if len(at) == 3:
        a, b, c = (size[i] for i in at)
        move = (b - c, c - a, a - b)
        if move == (0, 0, 0):
            move = (1.0, -1.0, 0.0)
    else:
        move = (1.0, -1.0)
    up = min((1 - chance[i]) / m if m > 0 else chance[i] / -m for i, m in zip(at, move) if m)
    down = min(chance[i] / m if m > 0 else (1 - chance[i]) / -m for i, m in zip(at, move) if m)
    by = up if draw() * (up + down) < down else -down
    for i, m in zip(at, move):
        p = chance[i] + by * m
        chance[i] = 0.0 if p < _NEAR else 1.0 if p > 1 - _NEAR else p


def _flight(chance: np.ndarray, size: np.ndarray, draw) -> np.ndarray:
    """The chances once at most two units, of unequal size, are left between 0 and 1."""
    chance, size, held = chance.tolist(), size.tolist(), []
    for i in range(len(chance)):
        if 0 < chance[i] < 1:
            held.append(i)
        while len(held) == 3 or (len(held) == 2 and size[held[0]] == size[held[1]]):
            _step(chance, size, held, draw)
            held = [j for j in held if 0 < chance[j] < 1]
    return np.array(chance)


def _land(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the few chances left so that the words taken come nearest to their expected number."""
    at = np.flatnonzero((chance > 0) & (chance < 1))
    if len(at):
        ways = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        words = np.abs(ways @ size[at] - (chance[at] * size[at]).sum())
        count = np.abs(ways.sum(axis=1) - chance[at].sum())
        chance = chance.copy()
        chance[at] = ways[np.lexsort((count, words))[0]]
    return chance


def _held(size: np.ndarray) -> np.ndarray:
    """Units of all sizes that skip the last flight, to land together with what it leaves."""
    order = np.argsort(size, kind="stable")
    return order[np.unique(np.linspace(0, len(order) - 1, min(_LANDING, len(order))).astype(int))] if len(order) else order


def _settle(last: bool, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "doc_id", "size"], kind="stable", na_position="last", ignore_index=True)
        key = [seed, int(rows["no"].iloc[0]), int(rows["part"].iloc[0]), int(last)]
        chance, size = rows["chance"].to_numpy(float), rows["size"].to_numpy(float)
        flies = np.ones(len(rows), bool)
        if last:
            open_ = np.flatnonzero((chance > 0) & (chance < 1))
            flies[open_[_held(size[open_])]] = False
        chance = chance.copy()
        chance[flies] = _flight(chance[flies], size[flies], np.random.default_rng(key).random)
        rows["chance"] = _land(chance, size) if last else chance
        return rows

    return run


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 7, keep: Sequence[str] = ()) -> DataFrame:
    """How often each document enters the mix: doc_id, source, size, source_size, target, copies, taken.

    Size is the number of words; `taken` is size times copies. A source is to
    give its target of words, so each of its documents is taken
    target / source_size times on average: the whole part always, the rest with
    a chance that the cube method turns into 0 or 1. Groups of documents of one
    source move three chances at a time along the null space of two
    constraints, the sum of chances (documents) and of chances times sizes
    (words), until fewer than three are undecided; what is left of many groups
    meets on the next level, and the last dozen of a source land where the words
    come nearest. A source may hold any share of the rows: its groups are of
    bounded size on every level. Groups and draws depend on hashes of the rows
    alone, so reruns agree.

    NULL and empty texts have size 0, an empty source target 0. Sources may be
    NULL; so may doc_id. Repeated rows are documents of their own. The
    columns that `keep` names come back too, others are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sizes = store(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.size(spaced_words(text)).cast("long").alias("size"), *keep))
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "own")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    parts = F.ceil(F.col("docs") / _UNITS)
    units = sizes.join(targets, F.col("source").eqNullSafe(F.col("own"))).withColumns({"rate": rate, "place": F.xxhash64("doc_id", "size")})
    units = units.withColumns({
        "whole": F.floor("rate").cast("long"), "chance": F.col("rate") - F.floor("rate"),
        "part": F.pmod(F.xxhash64("place", F.lit(seed)), parts)})
    units = units.select("doc_id", "source", "size", "source_size", "target", "no", "place", "part", "whole", "chance", *keep)
    most_parts = targets.agg(F.max(parts)).first()[0] or 1
    done = []
    while True:
        last = most_parts == 1
        units = store(units.groupBy("no", "part").applyInPandas(_settle(last, seed), units.schema))
        sure = (F.col("chance") == 0) | (F.col("chance") == 1)
        done.append(units.where(sure))
        if last:
            break
        units = units.where(~sure).withColumn("part", F.floor(F.col("part") / _FAN).cast(units.schema["part"].dataType))
        most_parts = -(-most_parts // _FAN)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    copies = F.col("whole") + F.col("chance").cast("long")
    return found.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *keep)


def mixed_corpus(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """The documents that the mix takes, all columns, with `size`, `target`, `copies` and `taken`.

    `copies` says how often a document is in the mix and `taken` its words there.
    Rows equal in all columns come back as one, with their copies added. What is
    decided meets the texts by two hashes of the whole row, so a NULL or repeated
    doc_id keeps its own text. Columns of `docs` with one of the four names give
    way to them.
    """
    names = [c for c in docs.columns if c not in ("size", "target", "copies", "taken")]
    whole = [x for c in names for x in (F.col(c).isNull(), F.col(c))]
    keyed = docs.select(*names, F.xxhash64(F.lit(1), *whole).alias("_a"), F.xxhash64(F.lit(2), *whole).alias("_b"))
    parts = store(mix(keyed, weights, most, seed, keep=("_a", "_b")).groupBy("_a", "_b").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("size").alias("size"), F.max("target").alias("target"),
        F.sum("copies").alias("copies"), F.sum("taken").alias("taken")).where("copies > 0"))
    found = keyed.join(parts, ["_a", "_b"])
    once = found.where("_rows = 1")
    if not parts.where("_rows > 1").isEmpty():
        once = once.unionByName(found.where("_rows > 1").dropDuplicates(["_a", "_b"]))
    return once.select(*names, "size", "target", "copies", "taken")
