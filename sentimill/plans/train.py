"""Training job: feature lines to a saved classifier."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.policy import LINE, REASON, check_policy
from ..operators.classifier import fit
from ..operators.parse import parse_training_lines
from ..sources.lines import held_blank_lines, split_states
from ..sources.records import save_model
from .outcome import SHORT_LINE, as_json, is_rejected, object_lines, refusal


def train(rows: DataFrame, **params) -> PipelineModel:
    """Fit on rows with ``review`` and ``label``; see ``classifier.fit`` for parameters."""
    return fit(rows, **params)


def run_train(
    spark: SparkSession,
    source: str,
    model_path: str,
    blank_lines: str = "inner",
    on_error: str = "fail",
    quarantine: str | None = None,
    report: dict | None = None,
    **params,
) -> PipelineModel:
    """Files, scanned once, to a saved model.

    Malformed lines end the job before anything is fitted. Under ``drop`` they are left out, counted
    in ``report`` and written to ``quarantine``, as in the other jobs, if these are given.
    """
    check_policy(on_error, ("fail", "drop"))
    rows = parse_training_lines(object_lines(spark, source, blank_lines), on_error="mark")

    def checked(kept: DataFrame) -> DataFrame:
        bad = kept.filter(is_rejected()).select(F.col(REASON).alias("reason"), F.col(LINE).alias("text"))
        blank = held_blank_lines(split_states(kept)).select(F.lit(SHORT_LINE).alias("reason"), F.col("value").alias("text"))
        bad = bad.unionByName(blank)
        if on_error == "fail":
            first = bad.select(refusal(F.col("reason"), F.col("text"))).first()
            if first:
                raise ValueError(first[0])
        elif quarantine:
            bad.select(as_json(F.col("reason"), F.col("text"))).write.text(quarantine)
        if report is not None:
            by_reason = dict(bad.groupBy("reason").count().collect())  # a row for each rule
            report.update(by_reason, rejected=sum(by_reason.values()))
        return kept.filter(F.col(REASON).isNull()).drop(REASON, LINE)

    model = fit(rows, check=checked, **params)
    save_model(model, model_path)
    return model
