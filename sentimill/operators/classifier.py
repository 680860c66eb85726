"""The review classifier: tokens, hashed counts, IDF, logistic regression (M1-M6)."""

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Tokenizer
from pyspark.sql import DataFrame, functions as F

from ..functions.policy import LINE, REASON, marks
from .text_stats import idf_weight

# Training parameters.
PARAMS = {"num_features": 1000, "min_doc_freq": 10, "max_iter": 10, "reg_param": 0.01}

# The variant that leaves these at Spark's defaults.
DEFAULT_PARAMS = {"num_features": 1 << 18, "min_doc_freq": 10, "max_iter": 100, "reg_param": 0.0}


# Non-zero numbers of a training partition for each feature: with fewer, adding up one
# gradient per partition would cost more than computing it.
WORK_PER_FEATURE = 4


def build_pipeline(
    num_features: int = PARAMS["num_features"],
    min_doc_freq: int = PARAMS["min_doc_freq"],
    max_iter: int = PARAMS["max_iter"],
    reg_param: float = PARAMS["reg_param"],
    tol: float = 1e-6,
    aggregation_depth: int = 2,
    max_block_size_in_mb: float = 0.0,
) -> Pipeline:
    """The unfitted pipeline over columns ``review`` and ``label``.

    The last three arguments are Spark's: the relative gain below which the fit ends,
    levels of the tree that adds up gradients, and size of the blocks of rows (0: Spark's choice).
    """
    return Pipeline(
        stages=[
            Tokenizer(inputCol="review", outputCol="words"),
            HashingTF(inputCol="words", outputCol="rawFeatures", numFeatures=num_features),
            IDF(inputCol="rawFeatures", outputCol="features", minDocFreq=min_doc_freq),
            LogisticRegression(
                maxIter=max_iter,
                regParam=reg_param,
                tol=tol,
                aggregationDepth=aggregation_depth,
                maxBlockSizeInMB=max_block_size_in_mb,
            ),
        ]
    )


def fit(rows: DataFrame, check: Callable[[DataFrame], DataFrame] | None = None, **params) -> PipelineModel:
    """Fit the pipeline on the distributed rows (M5).

    The same as ``build_pipeline(**params).fit(rows)``, but the text is read and
    tokenised once: IDF and the regression both work on the hashed counts, kept on the
    executors' disks, since the regression keeps its own blocks in memory. A lost
    executor's part is computed again from the source. The kept rows stand in as
    many partitions as their work is worth, never more than they came in.

    Rows that ``mark`` has kept are no rows to fit on: ``check`` gets the kept rows, marked ones
    with their marks, before the fit, and returns those to fit on, from what is kept.
    """
    tokenizer, hashing, idf, regression = build_pipeline(**params).getStages()
    text_stages = PipelineModel([tokenizer, hashing])
    marked = marks(rows)
    carried = [F.col(REASON), F.when(F.col(REASON).isNotNull(), F.col(LINE)).alias(LINE)] if marked else []
    review = F.when(F.col(REASON).isNull(), F.col("review")).otherwise("") if marked else F.col("review")
    hashed = text_stages.transform(rows.select(review.alias("review"), "label", *carried)).select(
        "rawFeatures", F.col("label").cast("double").alias("label"), *marked
    )
    hashed.persist(StorageLevel.DISK_ONLY)
    try:
        given = check(hashed) if check else hashed
        work = given.agg(F.sum(F.size(F.unwrap_udt("rawFeatures")["indices"]))).first()[0] or 0
        parts = max(1, int(work // (WORK_PER_FEATURE * hashing.getNumFeatures())))
        fitted = Pipeline(stages=[idf, regression]).fit(given.coalesce(parts))
    finally:
        hashed.unpersist()
    return PipelineModel([tokenizer, hashing, *fitted.stages])


def hashed_counts(
    df: DataFrame, doc_id: str, text: str = "text", num_features: int = PARAMS["num_features"]
) -> DataFrame:
    """``doc_id, bucket, tf`` of the hashed term counts (M2)."""
    words = Tokenizer(inputCol=text, outputCol="words").transform(df.select(doc_id, text))
    hashed = HashingTF(inputCol="words", outputCol="tf", numFeatures=num_features).transform(words)
    sparse = F.unwrap_udt("tf")
    cells = F.map_from_arrays(sparse["indices"], sparse["values"])
    return hashed.select(doc_id, F.explode(cells).alias("bucket", "tf"))


def hashed_idf(
    df: DataFrame,
    text: str = "text",
    num_features: int = PARAMS["num_features"],
    min_doc_freq: int = PARAMS["min_doc_freq"],
) -> DataFrame:
    """``bucket, doc_freq, idf`` as a fitted IDF has them (M3), one row per bucket.

    Both numbers are 0 for a bucket in fewer than ``min_doc_freq`` documents.
    """
    cells = hashed_counts(df.select(F.lit(0).alias("_doc"), text), "_doc", text, num_features)
    frequent = cells.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") >= min_doc_freq)
    buckets = df.sparkSession.range(num_features).select(F.col("id").cast("int").alias("bucket"))
    found = F.coalesce("n", F.lit(0).cast("long"))
    weight = idf_weight(F.lit(df.count()), found, min_doc_freq)
    return buckets.join(frequent, "bucket", "left").select("bucket", found.alias("doc_freq"), weight.alias("idf"))
