"""The distributed optimality check against numpy, and against models that are not at the optimum."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import sentimill as sm
from sentimill.operators.optimality import INTERCEPT

SF_DIR = "/root/testdata/sf0.001"
SETTLED = {"max_iter": 1000, "tol": 1e-12}


@pytest.fixture(scope="module")
def rows(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    return documents.join(labels, "doc_id").select(
        "doc_id", F.col("text").alias("review"), F.col("quality").cast("double").alias("label")
    )


def by_hand(model, rows, reg, standardized=True):
    """Objective and gradient, in the units of the penalty, from dense matrices."""
    found = model.transform(rows).select(vector_to_array("features").alias("x"), "label").collect()
    x, y = np.array([r["x"] for r in found]), np.array([r["label"] for r in found])
    w, b = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    std = x.std(axis=0, ddof=1)
    unit = std if standardized else np.ones_like(std)
    z = x @ w + b
    residual = 1 / (1 + np.exp(-z)) - y
    used = std > 1e-9
    slope = x[:, used].T @ residual / len(y) / unit[used] + reg * w[used] * unit[used]
    objective = np.mean(np.logaddexp(0, z) - y * z) + reg / 2 * np.sum((w * unit) ** 2)
    return objective, np.append(slope, residual.mean()), used.sum()


@pytest.mark.parametrize("params", [{}, SETTLED, {"max_iter": 0}])
def test_optimality_by_hand(rows, params):
    model = sm.train(rows, **params)
    found = sm.optimality(model, rows).first()
    objective, gradient, n_features = by_hand(model, rows, 0.01)
    assert found["objective"] == pytest.approx(objective, abs=1e-12)
    assert found["objective"] == pytest.approx(model.stages[-1].summary.objectiveHistory[-1], abs=1e-12)
    assert found["gradient_norm"] == pytest.approx(np.linalg.norm(gradient), abs=1e-12)
    assert found["largest_gradient"] == pytest.approx(np.abs(gradient).max(), abs=1e-12)
    assert (found["n_rows"], found["n_features"]) == (rows.count(), n_features)


def test_the_settled_fit_is_the_optimum_and_the_short_one_is_not(rows):
    settled = sm.optimality(sm.train(rows, **SETTLED), rows).first()
    short = sm.optimality(sm.train(rows), rows).first()
    assert settled["largest_gradient"] < 1e-7 < 1e-4 < short["largest_gradient"]
    assert settled["objective"] < short["objective"]


def test_moments_agree_at_the_optimum_only(rows):
    """Label and model moments differ by the penalty alone; on other rows they don't."""
    model = sm.train(rows, **SETTLED)
    penalty = 0.01 * F.col("weight") * F.pow("std", 2)
    apart = F.when(F.col("bucket") == INTERCEPT, 0.0).otherwise(penalty) + F.col("model_moment") - F.col("label_moment")
    found = sm.gradient_by_feature(model, rows)
    assert found.filter(F.abs(apart) > 1e-6).count() == 0
    other = sm.gradient_by_feature(model, rows.withColumn("label", 1 - F.col("label")))
    assert other.filter(F.abs("gradient") > 1e-2).count() > 10


def test_without_standardisation(rows):
    tokens, hashing, idf, _ = sm.build_pipeline().getStages()
    regression = LogisticRegression(maxIter=500, regParam=0.1, tol=1e-12, standardization=False)
    stages = PipelineModel(stages=[tokens, hashing, idf.fit(hashing.transform(tokens.transform(rows)))])
    model = PipelineModel(stages=[*stages.stages, regression.fit(stages.transform(rows))])
    found = sm.optimality(model, rows).first()
    objective, gradient, _ = by_hand(model, rows, 0.1, standardized=False)
    assert found["objective"] == pytest.approx(objective, abs=1e-12)
    assert found["gradient_norm"] == pytest.approx(np.linalg.norm(gradient), abs=1e-10)


def test_odd_rows(spark, rows):
    """No rows, one row, texts without a known feature, large margins."""
    model = sm.train(rows, **SETTLED)
    assert sm.optimality(model, rows.limit(0)).first()["n_rows"] is None
    one = sm.optimality(model, rows.limit(1)).first()
    assert one["n_rows"] == 1 and one["n_features"] == 0 and np.isfinite(one["objective"])
    blank = spark.createDataFrame([("", 1.0), ("  ", 0.0)], "review string, label double")
    assert sm.optimality(model, blank).first()["n_features"] == 1  # the empty token of the empty text
    long = spark.createDataFrame([(rows.first()["review"] * 500, 0.0), ("", 1.0)], "review string, label double")
    assert np.isfinite(sm.optimality(model, long).first()["objective"])
