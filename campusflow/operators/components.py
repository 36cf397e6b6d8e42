"""Connected components of a link table, by alternating star contractions.

Every round turns the links of each vertex into a star around the smallest
vertex it knows (first towards larger neighbours, then towards smaller ones),
which roughly halves the distances in a path, so a chain of ``n`` vertices is
done in about log2(n) rounds. A round is two partial minima and two equi
joins; the links are checkpointed and never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusflow.plans.common import checkpoint


def _towards_larger(links: DataFrame) -> DataFrame:
    """Each vertex sends its larger neighbours to the smallest it knows."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_least"))
    moved = both.where("b > a").join(least, "a").select(F.col("_least").alias("a"), "b")
    return moved.where("a <> b").distinct()


def _towards_smaller(links: DataFrame) -> DataFrame:
    """Each vertex sends itself and its smaller neighbours to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("_least"))
    joined = links.join(least, "b").select("_least", F.explode(F.array("a", "b")).alias("b"))
    return joined.where("_least <> b").select(F.col("_least").alias("a"), "b").distinct()


def components(links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, component) of every vertex of the undirected ``links`` (a, b): the
    smallest vertex that it is linked with, itself included, is its component.

    ``a`` and ``b`` are of one orderable type and not NULL; links of a vertex
    with itself and repeated links change nothing. ``max_rounds`` is for tests.
    """
    loops = links.where("a = b").select(F.col("a").alias("id"))
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links, seen, rounds = checkpoint(links), None, 0
    while True:
        # Stars only: every vertex is linked with its component and no other.
        stamp = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stamp == seen:
            break
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError("components did not settle")
        seen, links = stamp, checkpoint(_towards_smaller(_towards_larger(links)))
    found = links.select(F.col("b").alias("id"), F.col("a").alias("component"))
    heads = links.select(F.col("a").alias("id")).unionByName(loops).distinct().join(found.select("id"), "id", "left_anti")
    return found.unionByName(heads.withColumn("component", F.col("id")))


def linked_by(members: DataFrame, vertex: str, key: str) -> DataFrame:
    """Links (a, b) between the vertices that share a key: each member with the
    key's smallest, so a key of n members makes n links and not n * n."""
    least = members.groupBy(key).agg(F.min(vertex).alias("a"))
    return members.join(least, key).select("a", F.col(vertex).alias("b"))
