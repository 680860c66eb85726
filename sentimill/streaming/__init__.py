"""Structured Streaming jobs."""

from .feature_stream import features_stream, run_features_stream
from .score_stream import run_score_round, score_stream

__all__ = ["features_stream", "run_features_stream", "run_score_round", "score_stream"]
