"""Continuous scoring."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import score
from ..sources.records import load_model, model_version


def score_stream(
    model: PipelineModel,
    reviews: DataFrame,
    target: str,
    checkpoint: str,
    file_format: str = "parquet",
    trigger: dict | None = None,
    on_error: str = "fail",
) -> StreamingQuery:
    """Score a streaming frame (column ``review``) into files and return the running query.

    Stateless, so append mode needs no watermark. The checkpoint, in a folder all
    executors share, makes a restart go on where the last one stopped. The
    default ``trigger`` takes what is there and then stops; pass for example
    ``{"processingTime": "10 seconds"}`` to keep running. A null review stops the
    query with an error, or is left out under ``on_error="drop"``.
    """
    return _into_files(score(model, reviews, on_error), target, checkpoint, file_format, trigger)


def _into_files(scored: DataFrame, target: str, checkpoint: str, file_format: str, trigger: dict | None) -> StreamingQuery:
    return (
        scored.writeStream.format(file_format)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(target)
    )


def run_score_round(
    spark: SparkSession,
    model_path: str,
    reviews: DataFrame,
    target: str,
    checkpoint: str,
    file_format: str = "parquet",
    on_error: str = "fail",
) -> str:
    """Score what has come since the last round with the model that is current now. Returns its version.

    ``reviews`` is a streaming frame, ``model_path`` a folder that ``save_model`` writes to. Each answer
    has its ``model_version``. A model published between two rounds is used from the next one on; the
    checkpoint keeps the place in the stream. The files' own log names each batch, so one that
    is run again, after a stop between its files and its checkpoint, adds nothing: read the target through
    Spark, which follows that log.
    """
    version = model_version(model_path)
    if version is None:
        raise ValueError(f"no model has been published at {model_path}")
    scored = score(load_model(model_path, version), reviews, on_error).withColumn("model_version", F.lit(version))
    _into_files(scored, target, checkpoint, file_format, None).awaitTermination()
    return version
