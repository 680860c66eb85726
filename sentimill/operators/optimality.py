"""Is a fitted classifier at the optimum of its objective? (M4, M5)

The objective is Spark's: the mean logistic loss plus ``reg_param / 2`` times the squared
weights, these in units of the features' standard deviations where the regression
standardises. Its gradient over all rows is one aggregation: every row sends its residual
times each of its non-zero features, added up per feature and task before the shuffle.
The intercept is one more feature, 1 in every row, and brings the loss and the number of rows.
"""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

# The feature number of the intercept.
INTERCEPT = -1


def _weights(model: PipelineModel, spark) -> DataFrame:
    """``bucket, weight`` of the features with a weight other than zero; as many as the model is wide at most."""
    regression = model.stages[-1]
    sparse = [(i, float(w)) for i, w in enumerate(regression.coefficients.toArray()) if w]
    return spark.createDataFrame([(INTERCEPT, float(regression.intercept)), *sparse], "bucket int, weight double")


def _log_loss() -> Column:
    """Loss of a row from its margin ``z``, without overflow."""
    z, y = F.col("z"), F.col("label")
    return F.greatest(z, F.lit(0.0)) - y * z + F.log1p(F.exp(-F.abs(z)))


def gradient_by_feature(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``bucket, weight, mean, std, label_moment, model_moment, gradient, n_rows, log_loss`` of each feature.

    ``rows`` has ``review`` and ``label`` (0 or 1). The moments are the means over all rows of the
    feature times the label, and of the feature times the fitted probability. They are equal
    at the optimum, but for the penalty. ``gradient`` is in the units in which the regression is
    penalised. Features that are zero in all rows are left out; of the intercept, bucket -1,
    the mean is 1, and its row alone has the mean loss.
    """
    regression = model.stages[-1]
    scored = model.transform(rows.select("review", F.col("label").cast("double").alias("label"))).select(
        F.unwrap_udt("features").alias("x"),
        vector_to_array("rawPrediction")[1].alias("z"),
        vector_to_array("probability")[1].alias("p"),
        "label",
    )
    cell = F.struct(F.lit(INTERCEPT).alias("bucket"), F.lit(1.0).alias("x"))
    found = F.zip_with("x.indices", "x.values", lambda i, v: F.struct(i.alias("bucket"), v.alias("x")))
    cells = scored.select(
        F.explode(F.concat(F.array(cell), F.filter(found, lambda c: c["x"] != 0))).alias("c"), "p", "label", _log_loss().alias("loss")
    )
    x = F.col("c.x")
    sums = cells.groupBy(F.col("c.bucket").alias("bucket")).agg(
        F.sum(x).alias("s"),
        F.sum(x * x).alias("ss"),
        F.sum(x * F.col("label")).alias("xy"),
        F.sum(x * F.col("p")).alias("xp"),
        F.sum(F.when(F.col("c.bucket") == INTERCEPT, F.col("loss"))).alias("loss"),
    )
    total = sums.filter(F.col("bucket") == INTERCEPT).select(F.col("s").cast("long").alias("n_rows"))
    joined = sums.join(F.broadcast(total)).join(_weights(model, rows.sparkSession), "bucket", "left")  # one row
    n, weight = F.col("n_rows"), F.coalesce("weight", F.lit(0.0))
    variance = F.greatest((F.col("ss") - F.col("s") * F.col("s") / n) / F.greatest(n - 1, F.lit(1)), F.lit(0.0))
    own = F.when(F.col("bucket") != INTERCEPT, F.sqrt(variance)).otherwise(0.0)
    unit = F.when(own > 0, own) if regression.getStandardization() else F.lit(1.0)
    slope = (F.col("xp") - F.col("xy")) / n
    # A feature that never varies is left out of the fit.
    free = F.when(F.col("bucket") == INTERCEPT, slope).when(own > 0, slope / unit + regression.getRegParam() * weight * unit)
    return joined.select(
        "bucket",
        weight.alias("weight"),
        (F.col("s") / n).alias("mean"),
        own.alias("std"),
        (F.col("xy") / n).alias("label_moment"),
        (F.col("xp") / n).alias("model_moment"),
        F.coalesce(free, F.lit(0.0)).alias("gradient"),
        "n_rows",
        (F.col("loss") / n).alias("log_loss"),
    )


def optimality(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """One row: ``n_rows, n_features, log_loss, penalty, objective, gradient_norm, largest_gradient``.

    ``n_features`` is the number of features that vary. No rows give nulls and zeros.
    """
    regression = model.stages[-1]
    unit = F.col("std") if regression.getStandardization() else F.lit(1.0)
    feature = F.col("bucket") != INTERCEPT
    squares = F.sum(F.when(feature, F.pow(F.col("weight") * unit, 2)))
    penalty = F.coalesce(F.lit(regression.getRegParam() / 2) * squares, F.lit(0.0))
    return (
        gradient_by_feature(model, rows)
        .agg(
            F.max("n_rows").alias("n_rows"),
            F.count_if(feature & (F.col("std") > 0)).alias("n_features"),
            F.max("log_loss").alias("log_loss"),
            penalty.alias("penalty"),
            F.sqrt(F.sum(F.pow("gradient", 2))).alias("gradient_norm"),
            F.max(F.abs("gradient")).alias("largest_gradient"),
        )
        .select(
            "n_rows", "n_features", "log_loss", "penalty", (F.col("log_loss") + F.col("penalty")).alias("objective"),
            "gradient_norm", "largest_gradient",
        )
    )
