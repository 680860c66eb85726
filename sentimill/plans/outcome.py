"""A job's one pass over its input, written aside and published when it is known to be right.

The good records, the ones that break a rule, and the ends of file splits are written by the same
tasks into three folders beside the target. Then the small table of splits tells whether blank
lines at a split's end stand inside their file. Only then do the folders get their names: a reader
of the target sees the whole output of a job, or nothing of it.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.policy import LINE, REASON, check_policy
from ..sources.lines import SPLIT, held_blank_lines, read_object_lines, scan_object_lines, split_states
from ..sources.publish import beside, delete, exists, publish_folder, write_small

# The rule that an empty line breaks.
SHORT_LINE = "line has fewer than 4 fields"

MODES = ("errorifexists", "error", "overwrite", "append", "ignore")

_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def object_lines(spark: SparkSession, source: str | list[str], blank_lines: str) -> DataFrame:
    """Lines for a job: with ``inner``, from one scan and with the splits' ends among them."""
    return scan_object_lines(spark, source) if blank_lines == "inner" else read_object_lines(spark, source, blank_lines)


def is_rejected() -> Column:
    return F.col(REASON).isNotNull() & (F.col(REASON) != SPLIT)


def refusal(reason: Column | str, line: Column | str) -> Column:
    """The complaint about a record, with the beginning of its line."""
    return F.concat(reason, F.lit(": "), F.coalesce(F.substring(line, 1, 200), F.lit("null")))


def as_json(reason: Column, text: Column) -> Column:
    return F.to_json(F.struct(reason.alias("reason"), text.alias("text")))


def _taken(spark: SparkSession, path: str | None, mode: str) -> bool:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    there = path is not None and exists(spark, path)
    if there and mode in ("errorifexists", "error"):
        raise FileExistsError(f"path {path} already exists")
    return there


def write_outcome(
    marked: DataFrame,
    line: Column,
    target: str,
    on_error: str = "fail",
    mode: str = "errorifexists",
    quarantine: str | None = None,
    report: dict | None = None,
) -> None:
    """Write ``line`` of the unmarked rows of ``marked`` to ``target``, as lines.

    Under ``fail`` a marked record ends the job, and nothing is published. Under ``drop``
    it goes to ``quarantine``, as a JSON line with ``reason`` and ``text``, if that is given.
    ``report`` gets the number of rejected records, and that for each reason.
    """
    check_policy(on_error, ("fail", "drop"))
    spark = marked.sparkSession
    if _taken(spark, target, mode) and mode == "ignore":
        return
    if quarantine and _taken(spark, quarantine, mode) and mode == "ignore":
        return
    staged = beside(target, "staged")
    try:
        _write(marked, line, staged, on_error)
        splits, bad = f"{staged}/kind=splits", f"{staged}/kind=rejected"
        blank = held_blank_lines(_states(spark, splits)) if exists(spark, splits) else None
        if blank is not None and not blank.isEmpty():
            if on_error == "fail":
                raise ValueError(f"{SHORT_LINE}: ")
            blank.select(as_json(F.lit(SHORT_LINE), F.col("value"))).write.text(f"{staged}/blank")
            publish_folder(spark, f"{staged}/blank", bad, "append")
        if report is not None:
            found = rejected_lines(spark, bad).groupBy("reason").count() if exists(spark, bad) else None
            by_reason = dict(found.collect()) if found is not None else {}  # a row for each rule
            report.update(by_reason, rejected=sum(by_reason.values()))
        _publish(spark, f"{staged}/kind=lines", target, mode)
        if quarantine:
            _publish(spark, bad, quarantine, mode)
    finally:
        delete(spark, staged)


def _write(marked: DataFrame, line: Column, staged: str, on_error: str) -> None:
    """The one pass."""
    spark = marked.sparkSession
    kind = F.when(F.col(REASON).isNull(), "lines").when(F.col(REASON) == SPLIT, "splits").otherwise("rejected")
    refused = F.raise_error(refusal(F.col(REASON), F.col(LINE))) if on_error == "fail" else as_json(F.col(REASON), F.col(LINE))
    value = F.when(F.col(REASON).isNull(), line).when(F.col(REASON) == SPLIT, F.col(LINE)).otherwise(refused)
    before = spark.conf.get(_WRITERS, None)
    # The three folders' writers stay open side by side: tasks need not sort their rows by folder.
    spark.conf.set(_WRITERS, "3")
    try:
        out = marked.select(value.alias("value"), kind.alias("kind"))
        out.write.option("lineSep", "\n").partitionBy("kind").text(staged)
    finally:
        if before is None:
            spark.conf.unset(_WRITERS)
        else:
            spark.conf.set(_WRITERS, before)


def _states(spark: SparkSession, path: str) -> DataFrame:
    ends = spark.read.text(path).select(F.lit(SPLIT).alias(REASON), F.col("value").alias(LINE))
    return split_states(ends)


def _publish(spark: SparkSession, staged: str, target: str, mode: str) -> None:
    if not exists(spark, staged):
        spark.createDataFrame([], "value string").write.text(staged)
    publish_folder(spark, staged, target, mode)
    done = f"{target.rstrip('/')}/_SUCCESS"
    if not exists(spark, done):
        write_small(spark, done, "")


def rejected_lines(spark: SparkSession, quarantine: str) -> DataFrame:
    """``reason, text`` from a quarantine folder."""
    parsed = F.from_json("value", "reason string, text string")
    return spark.read.option("lineSep", "\n").text(quarantine).select(parsed.alias("r")).select("r.*")

