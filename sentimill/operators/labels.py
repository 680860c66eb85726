"""Labels of a review."""

from pyspark.sql import Column, functions as F

from ..functions.policy import checked
from ..functions.text import _col, equals_ignore_case, parse_int

# Fixed values.
LOWEST_POSITIVE_RATING = 3
POSITIVE_WORDS = ("neutral", "positive")


def rating_label(rating: Column | str, on_error: str = "fail") -> Column:
    """1 for a rating of three or more, else 0; text that is no integer is an error."""
    rating = _col(rating)
    number = checked(parse_int(rating), "rating is not an integer", rating, on_error)
    return (number >= LOWEST_POSITIVE_RATING).cast("int")


def sentiment_label(word: Column | str) -> Column:
    """1 for ``neutral`` or ``positive`` in any case, else 0."""
    return F.when(equals_ignore_case(word, *POSITIVE_WORDS), 1).otherwise(0)
