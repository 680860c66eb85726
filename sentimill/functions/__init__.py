"""Scalar building blocks, all plain column expressions."""

from .dates import (
    capitalised,
    raw_review_date,
    raw_review_hour,
    release_date,
    review_date,
)
from .policy import accepted, rejected, rejections
from .text import (
    equals_ignore_case,
    leading_fields,
    null_as_word,
    parse_double,
    parse_int,
    trim_controls,
)

__all__ = [
    "accepted",
    "capitalised",
    "equals_ignore_case",
    "leading_fields",
    "null_as_word",
    "parse_double",
    "parse_int",
    "raw_review_date",
    "raw_review_hour",
    "rejected",
    "rejections",
    "release_date",
    "review_date",
    "trim_controls",
]
