"""Connected components of a link table, by contraction.

Each round hooks every vertex to its smallest smaller neighbour (a partial
``min``), shortens the hooks to their roots and contracts the links. All steps
are joins and aggregations over tables in the shared folder; nothing is
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.llm.common import Shared


def _through(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``column`` replaced by its root where ``labels`` (id, root) has one."""
    found = labels.select(F.col("id").alias(column), F.col("root").alias("_root"))
    return df.join(found, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


def relabel(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct links (a < b) between the roots of their ends."""
    moved = _through(_through(links, "a", labels), "b", labels)
    return (
        moved.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def no_labels(shared: Shared) -> DataFrame:
    return shared.spark.createDataFrame([], "id long, root long")


def merge(shared: Shared, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, root) of all vertices that are not their own root, after
    the links (a, b) are added to the components that ``labels`` describes."""
    edges = shared.table(relabel(links, labels))
    while not edges.isEmpty():
        hooks = shared.table(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")))
        while True:
            up = hooks.select(F.col("id").alias("root"), F.col("root").alias("higher"))
            jumped = hooks.join(up, "root", "left")
            jumped = shared.table(jumped.select("id", F.coalesce("higher", "root").alias("root"), "higher"))
            hooks = jumped.select("id", "root")
            if jumped.where("higher is not null").isEmpty():
                break
        labels = shared.table(_through(labels, "root", hooks).select("id", "root").unionByName(hooks))
        edges = shared.table(relabel(edges, hooks))
    return labels
