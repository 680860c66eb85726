"""Typed record files (K3) and fitted models (K4, K5) at any URI."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .publish import current_version, new_version, publish_version


def write_records(
    df: DataFrame, path: str, file_format: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Write typed records (K3). ``avro`` works where Spark's Avro module is installed."""
    df.write.mode(mode).format(file_format).save(path)


def read_records(
    spark: SparkSession, path: str, schema: StructType | None = None, file_format: str = "parquet"
) -> DataFrame:
    """Read what ``write_records`` wrote."""
    reader = spark.read.format(file_format)
    return (reader.schema(schema) if schema else reader).load(path)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a part when ``df``, a plain file scan, has too few splits for that.

    For work that is heavy per row on small or unsplittable files. Fewer than two
    splits a core count as too few: the rows may all sit in one of them, as those
    of a columnar file with a single row group do. A core then shuffles two
    splits at most; a scan of more splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = cores > 1 and df.rdd.getNumPartitions() < 2 * cores
    return df.repartition(cores) if few else df


# Former versions of a model that stay when a new one is published.
KEPT_VERSIONS = 2


def save_model(model: PipelineModel, path: str, keep: int = KEPT_VERSIONS) -> str:
    """Save a fitted pipeline under ``path``, in the place of an earlier one (K4). Returns its version.

    The model is written whole to a folder of its own; then the small file that names the current
    version is replaced. Whoever loads meanwhile gets the former model or the new one, and a save that
    stops half-way leaves the former. ``keep`` former versions stay.
    """
    spark, version = SparkSession.active(), new_version()
    model.write().save(f"{path.rstrip('/')}/{version}")
    publish_version(spark, path, version, keep)
    return version


def model_version(path: str) -> str | None:
    """The version that ``load_model`` would load now; None for a folder without versions."""
    return current_version(SparkSession.active(), path)


def load_model(path: str, version: str | None = None) -> PipelineModel:
    """Load the current version of a fitted pipeline, or the one asked for (K5).

    A folder without versions is loaded as Spark's own model folder.
    """
    version = version or model_version(path)
    return PipelineModel.load(f"{path.rstrip('/')}/{version}" if version else path)
