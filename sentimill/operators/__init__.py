"""DataFrame operators."""

from .classifier import DEFAULT_PARAMS, PARAMS, build_pipeline, fit, hashed_counts, hashed_idf
from .frequency_state import (
    add_to_state,
    bucket_state,
    compact_state,
    idf_of,
    merged_state,
    read_state,
    term_frequencies_of,
    term_state,
)
from .labels import rating_label, sentiment_label
from .optimality import gradient_by_feature, optimality
from .parse import parse_quoted_lines, parse_review_lines, parse_training_lines, with_body
from .releases import (
    default_releases,
    read_releases,
    release_calendar,
    release_days,
    releases_by_year,
    with_after_release,
)
from .render import basic_line, feature_line
from .scoring import score, sentiment_message, with_defaults
from .text_stats import document_frequencies, term_frequencies, tf_idf, token_counts, tokens

__all__ = [
    "DEFAULT_PARAMS",
    "PARAMS",
    "add_to_state",
    "basic_line",
    "bucket_state",
    "build_pipeline",
    "compact_state",
    "default_releases",
    "document_frequencies",
    "feature_line",
    "fit",
    "gradient_by_feature",
    "hashed_counts",
    "hashed_idf",
    "idf_of",
    "merged_state",
    "optimality",
    "parse_quoted_lines",
    "parse_review_lines",
    "parse_training_lines",
    "rating_label",
    "read_releases",
    "read_state",
    "release_calendar",
    "release_days",
    "releases_by_year",
    "score",
    "sentiment_label",
    "sentiment_message",
    "term_frequencies",
    "term_frequencies_of",
    "term_state",
    "tf_idf",
    "token_counts",
    "tokens",
    "with_after_release",
    "with_body",
    "with_defaults",
]
