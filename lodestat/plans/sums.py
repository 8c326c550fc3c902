"""Vector sums over all rows: numpy per Arrow batch, one small shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def vector_sum(df: DataFrame, terms: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """Sum over the table of a vector that `terms` computes per batch.

    Every task folds its batches into one vector; the vectors of the tasks are
    added per position, so the driver receives `size` numbers.
    """

    def fold(batches):
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += terms(batch)
        yield pd.DataFrame({"part": [total]})

    parts = df.mapInPandas(fold, "part array<double>")
    rows = (
        parts.select(F.posexplode("part").alias("place", "x"))
        .groupBy("place").agg(F.sum("x").alias("x")).collect()
    )
    out = np.zeros(size)
    for row in rows:
        out[row["place"]] = row["x"]
    return out


class FourierFeatures:
    """Random cosine features whose inner products approach an RBF kernel
    (Rahimi and Recht 2007). The draw is fixed by the seed."""

    def __init__(self, dims: int, gamma: float, size: int = 256, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.weights = rng.normal(scale=np.sqrt(2.0 * gamma), size=(dims, size))
        self.shift = rng.uniform(0.0, 2.0 * np.pi, size=size)
        self.size = size

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / self.size) * np.cos(x @ self.weights + self.shift)
