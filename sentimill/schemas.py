"""Record layouts shared by the jobs."""

from pyspark.sql import types as T

# What the ingest job emits.
BASIC = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("sentiment", T.StringType()),
    ]
)

# D3: one review as the feature job reads it, all fields still text.
REVIEW = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("rating", T.StringType()),
        T.StructField("version", T.StringType()),
    ]
)

# Feature row.
FEATURES = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("afterRelease", T.BooleanType()),
        T.StructField("version", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

# Training and scoring row.
TRAINING = T.StructType(
    [
        T.StructField("review", T.StringType(), False),
        T.StructField("afterRelease", T.BooleanType(), False),
        T.StructField("version", T.StringType(), False),
        T.StructField("label", T.DoubleType(), False),
    ]
)
