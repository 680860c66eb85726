"""Ranks and running totals of groups that may hold most of the rows.

A window over a whole group is one task. Here each group is dealt into chunks, ranges
of its order: rows are ranked within their chunk, and the totals of the chunks before it
are added. What meets in one task is a chunk of a group, or one number per chunk.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

# Rows of a chunk, on average. The number of chunks follows the number of rows.
CHUNK_ROWS = 5_000


def chunk_count(n_rows: int, chunk_rows: int = CHUNK_ROWS) -> int:
    return max(1, -(-n_rows // chunk_rows))


def hash_chunk(order: str, chunks: int) -> Column:
    """The chunk of a row when rows stand in the order of ``order``, evenly spread longs."""
    # The upper 31 bits as a number from 0 on, cut into even ranges.
    top = F.shiftright(F.col(order), 33) + F.lit(1 << 30)
    return F.floor(top * F.lit(chunks) / F.lit(float(1 << 31))).cast("long")


def running_totals(
    df: DataFrame,
    group: list[str],
    chunk: Column,
    order: list[Column | str],
    value: Column,
    attributes: DataFrame | None = None,
) -> DataFrame:
    """Add ``before`` and ``through``: totals of ``value`` in ``group`` up to each row.

    Rows stand in the order of ``chunk``, a long, then of ``order``. Rows alike in all
    of these are interchangeable. ``group`` must not be null. ``attributes``, one row
    a group, are columns to add as well: they arrive with the offsets of the chunks.
    ``df`` is evaluated twice.
    """
    dealt = df.withColumns({"_value": value.cast("long"), "_chunk": chunk})
    keys = [*group, "_chunk"]
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*keys)
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    )
    added = []
    if attributes is not None:
        added = [c for c in attributes.columns if c not in group]
        offsets = offsets.join(attributes, group)
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    through = F.col("_offset") + F.col("_running")
    return (
        dealt.withColumn("_running", F.sum("_value").over(here))
        .join(offsets, keys)
        .select(*df.columns, *added, (through - F.col("_value")).alias("before"), through.alias("through"))
    )


def global_ranks(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Add ``name``, the place from 0 on of each row by ``order``, whose values are distinct.

    Ranges are sorted apart, and the sizes of the ranges before are added: the only
    window over everything has one row per range.
    """
    ranged = df.repartitionByRange(order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return (
        ranged.withColumn("_within", within)
        .join(starts, "_range")
        .select(*df.columns, (F.col("_start") + F.col("_within")).alias(name))
    )
