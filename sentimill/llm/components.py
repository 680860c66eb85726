"""Connected components of a graph that no single machine holds: distributed union-find.

Every node points at its smallest neighbour, pointers are followed to their roots by
doubling, and the edges that remain between roots are a smaller graph for the next
level. Each level at least halves the nodes that still have edges. Only counts reach
the driver. Groups are aggregated before the shuffle, so a node with very many edges
is one row a task. The tables of a level are written by as many tasks as its edges need.
"""

from pyspark.sql import DataFrame, functions as F

from .common import written

# Edges for each task that writes a table of a level; there are tasks for all cores anyway.
TASK_EDGES = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``, of one comparable type, not null).

    ``root`` is one node of the component, the same for all of it. Edges may repeat,
    point either way and lead from a node to itself. No edges give no rows.
    """
    labels = None
    current = written(_clean(edges), "edges")
    while n := current.count():
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_EDGES))
        roots = _roots(current, tasks)
        if labels is None:
            labels = roots
        else:
            moved = roots.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            labels = written(
                labels.join(moved, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "labels"
            )
        current = written(_clean(_follow(_follow(current, roots, "a"), roots, "b")).coalesce(tasks), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return labels


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()


def _follow(edges: DataFrame, roots: DataFrame, end: str) -> DataFrame:
    to = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
    return edges.join(to, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root").select("a", "b")


def _roots(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node with the root of its tree when all point at their smallest neighbour or themselves."""
    both = edges.union(edges.select("b", "a")).toDF("node", "other")
    pointers = both.groupBy("node").agg(F.least("node", F.min("other")).alias("root"))
    pointers = written(pointers.coalesce(tasks), "pointers")
    while True:
        onward = pointers.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        doubled = pointers.join(onward, "root").select(
            "node", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")
        )
        doubled = written(doubled.coalesce(tasks), "pointers")
        if doubled.filter("_moved").isEmpty():
            return pointers
        pointers = doubled.drop("_moved")
