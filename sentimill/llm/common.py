"""Helpers that several operators share."""

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_path

_HOME = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python workers find this package where the driver does, if it is not installed."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", _HOME)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and cut from its lineage.

    Any executor can read it again after another one is lost. Whoever owns the
    folder of ``spark.checkpoint.dir`` removes it.
    """
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_once(df: DataFrame, purpose: str) -> DataFrame:
    """``written``, and the job's shuffle files go when it ends: nothing else reads them."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return written(df, purpose)
    finally:
        conf.set(name, before)


def released(df: DataFrame) -> None:
    """Give back the space of a table from ``written`` that nothing will read again: it is empty afterwards."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(folder)


def whole_text(text: Column | str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
