"""Saving models, loading them and scoring tables with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from lodestat.operators.models import Model, with_known_predictions


def save_model(model: Model | PipelineModel, path: str) -> None:
    """Write the fitted pipeline of an MLlib-backed model, replacing what is there."""
    fitted = model.fitted if isinstance(model, Model) else model
    if not isinstance(fitted, PipelineModel):
        raise ValueError("This model has no saved form.")
    fitted.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_saved(
    df: DataFrame, path: str, preprocessing: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The rows with the `prediction` of a saved model, after optional preparation.

    Rows with a missing feature stay, with a NULL prediction. Classes that were
    indexed for the fit come back as text.
    """
    ready = preprocessing(df) if preprocessing else df
    fitted = load_model(path)
    features = next((s.getInputCols() for s in fitted.stages if isinstance(s, VectorAssembler)), [])
    return with_known_predictions(fitted.transform(ready), ready, features)
