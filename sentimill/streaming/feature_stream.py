"""Feature rows of arriving review lines (B2, J1 on a stream)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.policy import check_policy
from ..operators.releases import read_releases
from ..operators.render import feature_line
from ..plans.features import build_features


def features_stream(
    lines: DataFrame,
    releases: DataFrame,
    target: str,
    checkpoint: str,
    trigger: dict | None = None,
    on_error: str = "fail",
) -> StreamingQuery:
    """Feature lines of a streaming frame of review lines (column ``value``), into files.

    The calendar's days are the static side of a stream-static join, broadcast in each batch as in
    the batch job; nothing is kept between batches, so the stream needs no watermark. Empty lines are no
    records: where a file ends is not known to a stream.
    """
    check_policy(on_error, ("fail", "drop"))
    features = build_features(lines.filter("value != ''"), releases, on_error=on_error)
    return (
        features.select(feature_line().alias("value"))
        .writeStream.format("text")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(target)
    )


def run_features_stream(
    spark: SparkSession, source: str, calendar: str, target: str, checkpoint: str, on_error: str = "fail"
) -> None:
    """One round: the lines that have come into the folder ``source`` since the last one.

    The calendar file is read anew in each round, so that dates added to it count for the lines that
    arrive later; lines of earlier rounds keep their answer.
    """
    lines = spark.readStream.option("lineSep", "\n").text(source)
    features_stream(lines, read_releases(spark, calendar), target, checkpoint, on_error=on_error).awaitTermination()
