"""Scoring job: a saved classifier applied to any number of reviews."""

from pyspark.sql import DataFrame

from ..operators.scoring import score
from ..sources.records import load_model


def run_score(model_path: str, reviews: DataFrame, on_error: str = "fail") -> DataFrame:
    """``reviews`` (column ``review``) with ``prediction`` and ``message``."""
    return score(load_model(model_path), reviews, on_error)
