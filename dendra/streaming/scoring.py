"""Scores of streams by a fitted model: stateless, so any output mode without watermarks will do."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.model import FittedModel


def predict_stream(model: FittedModel, stream: DataFrame) -> DataFrame:
    """(id, label, probability) of a stream of (id, features); a vector of the wrong width stops the query."""
    return model.predictor().predict(stream)


def score_stream(model: FittedModel, stream: DataFrame) -> DataFrame:
    """(id, outlier_score)."""
    return model.predictor().scores(stream)
