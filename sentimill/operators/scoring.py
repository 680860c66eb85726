"""Scoring reviews with a fitted classifier (P10, P11, M6). Works on batch and stream."""

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.policy import check_policy, settle
from ..functions.text import _col


def with_defaults(reviews: DataFrame) -> DataFrame:
    """Bare reviews as scoring rows: the other training columns get fixed values (P10)."""
    return reviews.withColumns(
        {
            "afterRelease": F.lit(False),
            "version": F.lit("0"),
            "label": F.lit(0.0),
        }
    )


def sentiment_message(prediction: Column | str = "prediction") -> Column:
    """The answer for one prediction."""
    word = F.when(_col(prediction) == 1.0, "positive").otherwise("negative")
    return F.concat(F.lit("Sentiment is "), word)


def score(model: PipelineModel, reviews: DataFrame, on_error: str = "fail") -> DataFrame:
    """Add ``prediction`` and ``message`` to reviews (column ``review``), any number of them.

    All columns of ``reviews``, such as a key or a known label, pass through as
    they are. A null review ends the job with an error or, under ``drop``, is left out.
    """
    check_policy(on_error, ("fail", "drop"))
    rows = reviews.select("review", F.struct("*").alias("_given"))
    rows = settle(rows, [("review", "review without a text", "review")], on_error)
    return model.transform(with_defaults(rows)).select(
        "_given.*", "prediction", sentiment_message().alias("message")
    )
