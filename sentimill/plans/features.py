"""Feature job: review lines and a release calendar to feature rows."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import raw_review_date, raw_review_hour, review_date
from ..functions.policy import check_policy, marks, settle
from ..operators.labels import rating_label, sentiment_label
from ..operators.parse import parse_review_lines, with_body
from ..operators.releases import default_releases, with_after_release
from ..operators.render import feature_line
from .outcome import object_lines, write_outcome

FEATURE_COLUMNS = ("text", "afterRelease", "version", "label")


def build_features(
    lines: DataFrame, releases: DataFrame, line: str = "value", on_error: str = "fail"
) -> DataFrame:
    """``date,version,rating,body`` lines to ``text, afterRelease, version, label`` (B2).

    Reviews without a body leave before their date and rating are read.
    """
    reviews = with_body(parse_review_lines(lines, line, on_error))
    typed = reviews.select(
        F.col("body").alias("text"),
        "version",
        "rating",
        rating_label("rating", "drop").alias("label"),
        F.col("date").alias("_date"),
        review_date("date").alias("date"),
        *marks(reviews),
    )
    checks = [
        ("label", "rating is not an integer", "rating"),
        ("date", "not a MMM dd yyyy date", "_date"),
    ]
    flagged = with_after_release(settle(typed, checks, on_error), releases, on_error=on_error)
    return flagged.select(*FEATURE_COLUMNS, *marks(flagged))


def build_features_legacy(
    basic: DataFrame, releases: DataFrame, on_error: str = "fail"
) -> DataFrame:
    """Ingested ``text, date, sentiment`` records to feature rows.

    The label comes from the sentiment word, and ``version`` holds the hour of
    day of the review (P7c).
    """
    typed = basic.select(
        "text",
        raw_review_hour("date").cast("string").alias("version"),
        sentiment_label("sentiment").alias("label"),
        F.col("date").alias("_date"),
        raw_review_date(F.col("date")).alias("date"),
        *marks(basic),
    )
    checks = [(c, "not a d/M/yyyy HH:mm:ss date", "_date") for c in ("version", "date")]
    flagged = with_after_release(settle(typed, checks, on_error), releases, on_error=on_error)
    return flagged.select(*FEATURE_COLUMNS, *marks(flagged))


def run_features(
    spark: SparkSession,
    source: str,
    target: str,
    releases: DataFrame | None = None,
    blank_lines: str = "inner",
    on_error: str = "fail",
    mode: str = "errorifexists",
    quarantine: str | None = None,
    report: dict | None = None,
) -> None:
    """Files to files in one scan; the only exchange is the broadcast of the calendar's days.

    With ``blank_lines="inner"`` an empty line is a malformed one unless nothing but empty
    lines follows in its file. See ``write_outcome`` for the last three arguments, and for how the
    output is published.
    """
    check_policy(on_error, ("fail", "drop"))
    calendar = default_releases(spark) if releases is None else releases
    features = build_features(object_lines(spark, source, blank_lines), calendar, on_error="mark")
    write_outcome(features, feature_line(), target, on_error, mode, quarantine, report)
