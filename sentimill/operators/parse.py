"""Line parsers: text lines to the typed records of the jobs."""

from pyspark.sql import DataFrame, functions as F

from ..functions.policy import LINE, REASON, marks, settle
from ..functions.text import equals_ignore_case, leading_fields, parse_double, trim_controls


def _fields(lines: DataFrame, separator: str, n: int, line: str, on_error: str) -> DataFrame:
    """The first ``n`` fields of each line as column ``_f``. Rows that are marked already stay so."""
    fields = leading_fields(line, separator, n).alias("_f")
    if marks(lines):
        split = lines.select(REASON, F.coalesce(line, LINE).alias(LINE), fields)
    else:
        split = lines.select(F.col(line).alias(LINE), fields)
    return settle(split, [("_f", f"line has fewer than {n} fields", LINE)], on_error)


def parse_quoted_lines(lines: DataFrame, line: str = "value", on_error: str = "fail") -> DataFrame:
    """``"id","date","text","sentiment",...`` lines to ``text, date, sentiment``.

    The separator is quote-comma-quote, so commas inside a field survive. The
    outermost quotes of a line stay with the first and last field.
    """
    f, rows = F.col("_f"), _fields(lines, '","', 4, line, on_error)
    return rows.select(f[2].alias("text"), f[1].alias("date"), f[3].alias("sentiment"), *marks(rows))


def parse_review_lines(lines: DataFrame, line: str = "value", on_error: str = "fail") -> DataFrame:
    """``date,version,rating,body`` lines to ``date, body, rating, version``.

    Every field is trimmed. The body ends at its first comma.
    """
    f, rows = F.col("_f"), _fields(lines, ",", 4, line, on_error)
    return rows.select(
        trim_controls(f[0]).alias("date"),
        trim_controls(f[3]).alias("body"),
        trim_controls(f[2]).alias("rating"),
        trim_controls(f[1]).alias("version"),
        *marks(rows),
    )


def with_body(reviews: DataFrame) -> DataFrame:
    """Keep reviews whose trimmed body is not empty (F1), and marked ones."""
    kept = F.col("body") != ""
    return reviews.filter(F.coalesce(kept, F.lit(False)) | F.col(REASON).isNotNull() if marks(reviews) else kept)


def parse_training_lines(
    lines: DataFrame, line: str = "value", on_error: str = "fail"
) -> DataFrame:
    """``text,afterRelease,version,label`` lines to training rows.

    Only the word ``true``, in any case, is true; all other text is false.
    """
    f, fields = F.col("_f"), _fields(lines, ",", 4, line, on_error)
    rows = fields.select(
        f[0].alias("review"),
        equals_ignore_case(f[1], "true").alias("afterRelease"),
        f[2].alias("version"),
        parse_double(f[3]).alias("label"),
        f[3].alias("_label"),
        *marks(fields),
    )
    return settle(rows, [("label", "label is not a number", "_label")], on_error).drop("_label")
