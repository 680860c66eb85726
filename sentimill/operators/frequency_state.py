"""Document frequencies as a table that new documents are added to (A5, M3).

A state has a row for each term, or bucket, with the number of documents that hold it, and one
for the null key with the number of documents. Counts of different documents add up, so states
merge by one aggregation, and IDF weights follow from a merged state without reading any text.

A table of states is a folder of one state a batch. A batch that is written again replaces
itself, so a repeated job counts nothing twice.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.publish import beside, exists, publish_folder
from .classifier import PARAMS, hashed_counts
from .text_stats import _frequencies, idf_weight


def term_state(docs: DataFrame, text: str = "text") -> DataFrame:
    """``key, df`` for each term of the documents, and their number for the null key."""
    return _frequencies(docs, text).withColumnRenamed("term", "key")


def bucket_state(docs: DataFrame, text: str = "text", num_features: int = PARAMS["num_features"]) -> DataFrame:
    """``key, df`` for each bucket of the hashed terms, and the number of documents for the null key."""
    counts = hashed_counts(docs.select(F.lit(0).alias("_doc"), text), "_doc", text, num_features)
    buckets = counts.groupBy(F.col("bucket").alias("key")).agg(F.count("*").alias("df"))
    return buckets.unionByName(docs.agg(F.lit(None).cast("int").alias("key"), F.count("*").alias("df")))


def merged_state(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The state of the documents of all given states together."""
    everything = first
    for state in others:
        everything = everything.unionByName(state)
    return everything.groupBy("key").agg(F.sum("df").alias("df"))


def add_to_state(state: DataFrame, path: str, batch: str) -> None:
    """Write a state as batch ``batch`` of the table at ``path``, in the place of an earlier one of that name.

    The batch appears whole or not at all. Names are letters, digits, ``-``, ``_`` and ``.``.
    """
    if not batch or not all(c.isalnum() or c in "-_." for c in batch):
        raise ValueError(f"not a name of a batch: {batch!r}")
    spark, target = state.sparkSession, f"{path.rstrip('/')}/batch={batch}"
    staged = beside(target, "staged")
    state.write.parquet(staged)
    publish_folder(spark, staged, target, "overwrite")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The merged state of all batches of a table."""
    return merged_state(spark.read.parquet(path).drop("batch"))


def compact_state(spark: SparkSession, path: str, target: str) -> None:
    """The merged state of a table as the only batch, ``compacted``, of a new table."""
    if exists(spark, target):
        raise FileExistsError(f"path {target} already exists")
    add_to_state(read_state(spark, path), target, "compacted")


def term_frequencies_of(state: DataFrame) -> DataFrame:
    """``term, df`` as ``document_frequencies`` has them."""
    return state.filter("key IS NOT NULL").select(F.col("key").alias("term"), "df")


def idf_of(
    state: DataFrame, num_features: int = PARAMS["num_features"], min_doc_freq: int = PARAMS["min_doc_freq"]
) -> DataFrame:
    """``bucket, doc_freq, idf`` of a state of buckets, as ``hashed_idf`` has them: one row per bucket."""
    total = state.filter("key IS NULL").agg(F.coalesce(F.max("df"), F.lit(0)).alias("_n"))
    frequent = state.filter(F.col("key").isNotNull() & (F.col("df") >= min_doc_freq)).select(F.col("key").alias("bucket"), "df")
    buckets = state.sparkSession.range(num_features).select(F.col("id").cast("int").alias("bucket"))
    found = F.coalesce("df", F.lit(0).cast("long"))
    joined = buckets.join(frequent, "bucket", "left").join(F.broadcast(total))  # one row
    return joined.select("bucket", found.alias("doc_freq"), idf_weight(F.col("_n"), found, min_doc_freq).alias("idf"))
