"""Ingest job: raw quoted review lines to ``text,date,sentiment`` lines (B1)."""

from pyspark.sql import DataFrame, SparkSession

from ..functions.policy import check_policy
from ..operators.parse import parse_quoted_lines
from ..operators.render import basic_line
from ..sources.lines import read_lines
from .outcome import write_outcome


def ingest(lines: DataFrame, line: str = "value", on_error: str = "fail") -> DataFrame:
    """``text, date, sentiment`` records of raw lines."""
    return parse_quoted_lines(lines, line, on_error)


def run_ingest(
    spark: SparkSession,
    source: str,
    target: str,
    on_error: str = "fail",
    mode: str = "errorifexists",
    quarantine: str | None = None,
    report: dict | None = None,
) -> None:
    """Files to files, in one stage without a shuffle; see ``write_outcome`` for the last three arguments."""
    check_policy(on_error, ("fail", "drop"))
    records = ingest(read_lines(spark, source), on_error="mark")
    write_outcome(records, basic_line(), target, on_error, mode, quarantine, report)
