"""The jobs: compositions of sources, operators and sinks."""

from .features import build_features, build_features_legacy, run_features
from .ingest import ingest, run_ingest
from .outcome import rejected_lines
from .score import run_score
from .train import run_train, train

__all__ = [
    "build_features",
    "build_features_legacy",
    "ingest",
    "rejected_lines",
    "run_features",
    "run_ingest",
    "run_score",
    "run_train",
    "train",
]
