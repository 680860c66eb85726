"""Records as comma-joined lines, without quoting or escaping."""

from pyspark.sql import Column, functions as F

from ..functions.text import null_as_word


def basic_line() -> Column:
    """``text,date,sentiment``."""
    return F.concat(F.col("text"), F.lit(","), F.col("date"), F.lit(","), F.col("sentiment"))


def feature_line() -> Column:
    """``text,afterRelease,version,label``; null is spelled ``null``."""
    fields = ("text", "afterRelease", "version", "label")
    return F.concat_ws(",", *[null_as_word(f) for f in fields])
