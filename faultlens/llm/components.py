"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import checksum
from faultlens.runtime import pin


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie the larger neighbours of every node to its smallest neighbour."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    least = pin(least.select("a", F.least("a", "m").alias("m")))
    return near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them; edges have a > b."""
    least = pin(edges.groupBy("a").agg(F.min("b").alias("m")))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in the links ``(a, b)``.

    The component is the smallest id reachable. Rows with a null end and links of
    an id with itself are dropped. Each round is written to the shared folder,
    which cuts the lineage and survives lost executors; the minimum of a node's
    neighbours is aggregated before it is joined, so a node with very many links
    is an aggregate and, as that is written first, a join that Spark can split. The rounds
    end when the links are stars, which no round changes.
    """
    edges = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    edges = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = pin(edges.distinct())
    seen = checksum(edges)
    while seen[0]:
        edges = pin(_small_star(pin(_large_star(edges))))
        now = checksum(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        roots.select("id", F.col("id").alias("component"))
    )
