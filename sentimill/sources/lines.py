"""Text line and CSV sources, text sink.

Paths are anything Spark's file systems reach; large files are read in splits by
many tasks, and sinks write one part per task.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.policy import LINE, REASON, check_policy, computed_once
from ..operators.parse import parse_training_lines
from ..session import shared_path

# The function that tasks run goes to them whole: executors need not have this package.
register_pickle_by_value(sys.modules[__name__])

BLANK_LINES = ("inner", "skip", "keep")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row ``value`` per line, whatever the line ending."""
    return spark.read.text(path)


def read_object_lines(
    spark: SparkSession, path: str | list[str], blank_lines: str = "inner"
) -> DataFrame:
    """One row ``value`` per line; only ``\\n`` ends a line, a ``\\r`` stays.

    ``blank_lines``: ``inner`` keeps empty lines except those after the last text
    of a file. ``skip`` leaves all empty lines out and ``keep`` keeps all. They
    agree on files without empty lines. ``skip`` and ``keep`` are plain lazy scans;
    ``inner`` scans the files once, now, into the shared folder (see ``shared_path``), since
    only the end of a file's last split tells which lines these are. The jobs, which write
    anyway, do without that copy.
    """
    if blank_lines not in BLANK_LINES:
        raise ValueError(f"blank_lines must be one of {BLANK_LINES}, not {blank_lines!r}")
    if blank_lines == "inner":
        staged = shared_path(spark, "object-lines")
        scan_object_lines(spark, path).write.parquet(staged)
        scanned = spark.read.schema(_SCANNED).parquet(staged)
        lines = scanned.filter(F.col(REASON).isNull()).select("value")
        return lines.unionByName(held_blank_lines(split_states(scanned)))
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines if blank_lines == "keep" else lines.filter(F.col("value") != "")


# The mark of rows that stand for the end of a split, not for a line.
SPLIT = "end of a split"

_SCANNED = f"value string, {REASON} string, {LINE} string"
_STATE = "file long, start long, blanks long, text boolean"

# Blank lines written out at once.
_CHUNK = 10_000


def scan_object_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All lines up to the last text of each file split, and one row for the split's end, in one scan.

    Line rows have ``value``. End rows are marked ``SPLIT`` and hold, as JSON in the place of
    the line, the split's place, the number of blank lines after its last text, and whether it has
    any text. Operators pass marked rows on, so both can go through a job's one pass, and the
    splits' rows, a small table, tell afterwards which blank lines at a split's end stand
    inside their file.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    placed = lines.select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    return placed.mapInArrow(_held_back, _SCANNED)


def _held_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines as they come, but blank ones only when text follows in their split."""
    split, blanks, text = None, 0, False
    for batch in batches:
        value, file, start = batch.columns
        places = np.stack([file.to_numpy(), start.to_numpy()])
        edges = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(0)) + 1
        filled = pc.not_equal(value, "").to_numpy(zero_copy_only=False)
        for low, high in zip([0, *edges], [*edges, batch.num_rows]):
            if low == high:
                continue
            here = tuple(int(x) for x in places[:, low])
            if here != split:
                if split:
                    yield _end_of(split, blanks, text)
                split, blanks, text = here, 0, False
            found = np.flatnonzero(filled[low:high])
            if not len(found):
                blanks += int(high - low)
                continue
            for at in range(0, blanks, _CHUNK):
                yield _line_batch(pa.array([""] * min(_CHUNK, blanks - at), pa.string()))
            after = low + int(found[-1]) + 1
            yield _line_batch(value.slice(low, after - low).cast(pa.string()))
            blanks, text = int(high - after), True
    if split:
        yield _end_of(split, blanks, text)


def _line_batch(values: pa.Array) -> pa.RecordBatch:
    nothing = pa.nulls(len(values), pa.string())
    return pa.RecordBatch.from_arrays([values, nothing, nothing], ["value", REASON, LINE])


def _end_of(split: tuple[int, int], blanks: int, text: bool) -> pa.RecordBatch:
    state = f'{{"file":{split[0]},"start":{split[1]},"blanks":{blanks},"text":{str(text).lower()}}}'
    columns = [pa.array([x], pa.string()) for x in (None, SPLIT, state)]
    return pa.RecordBatch.from_arrays(columns, ["value", REASON, LINE])


def split_states(scanned: DataFrame) -> DataFrame:
    """``file, start, blanks, text`` of the end rows of a scanned, or marked, frame."""
    ends = scanned.filter(F.col(REASON) == SPLIT)
    return ends.select(F.from_json(LINE, _STATE).alias("s")).select("s.*")


def held_blank_lines(states: DataFrame) -> DataFrame:
    """``value``: the blank lines at the end of a split with text in a later split of its file."""
    last = states.filter("text").groupBy("file").agg(F.max("start").alias("_last"))
    held = states.filter("blanks > 0").join(last, "file").filter(F.col("start") < F.col("_last"))
    return (
        held.select("blanks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blanks") - 1, F.lit(_CHUNK).cast("long"))).alias("at"))
        .select(F.least(F.lit(_CHUNK), F.col("blanks") - F.col("at")).cast("int").alias("n"))
        .select(F.explode(F.array_repeat(F.lit(""), F.col("n"))).alias("value"))
    )


def read_training_rows(
    spark: SparkSession, path: str | list[str], blank_lines: str = "inner", on_error: str = "fail"
) -> DataFrame:
    """Training rows from feature lines (S4). Empty lines as in ``read_object_lines``."""
    return parse_training_lines(read_object_lines(spark, path, blank_lines), on_error=on_error)


# Lines that the types of a CSV are taken from.
SAMPLE_LINES = 1_000

_UNFIT = "_unfit"


def read_header_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    sample_lines: int = SAMPLE_LINES,
    on_error: str = "fail",
    **options,
) -> DataFrame:
    """CSV with a header line in each file, UTF-8 (S5). ``options`` go to Spark's reader.

    Without ``schema`` the types are those of the first ``sample_lines`` lines, and the one whole
    scan holds all lines to them: a line with a value of another type, or with too many or too few
    fields, ends the job with an error that quotes it, or is left out under ``drop``. Give
    the schema where a column's type shows late. With a schema of your own, Spark's options decide.
    """
    check_policy(on_error, ("fail", "drop"))
    reader = spark.read.options(**options).option("header", True).option("encoding", "UTF-8")
    if schema:
        return reader.schema(schema).csv(path)
    sampled = [r[0] for r in spark.read.text(path).limit(sample_lines).collect()]
    # Several files, several headers.
    lines = sampled[:1] + [x for x in sampled if x != sampled[0]]
    sample = shared_path(spark, "csv-sample")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(sample)
    types = reader.option("inferSchema", True).csv(sample).schema
    rows = (
        reader.option("inferSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _UNFIT)
        .schema(StructType([*types.fields, StructField(_UNFIT, StringType())]))
        .csv(path)
    )
    fits = F.col(_UNFIT).isNull()
    if on_error == "fail":
        error = F.raise_error(F.concat(F.lit("line doesn't fit the types of the first ones: "), F.substring(_UNFIT, 1, 200)))
        fits = F.when(fits, True).otherwise(error.cast("boolean"))
    return computed_once(rows, fits).drop(_UNFIT)


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a frame of one text column as lines (K1, K2, A1).

    Each task writes its own part file: joining all lines into one object would
    pass the whole data through one task.
    """
    lines.write.mode(mode).option("lineSep", "\n").text(path)
