"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.stage import files_for, staged


#: Nodes up to which the least neighbour of each is broadcast (8 MB of numbers), and nodes to a file.
BROADCAST_NODES, FILE_NODES = 500_000, 50_000


def _star(pairs: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (u, v): each u with the least of itself and its neighbours, and the pairs."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return least, pairs.join(F.broadcast(least) if few else least, "u")


def large_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Link every neighbour that is larger than a node to the least of its neighbourhood: a row for each edge."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    _, linked = _star(both, few)
    return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Edges have v < u."""
    least, linked = _star(edges, few)
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )
    return out.filter("u != v").distinct()


def components(edges: DataFrame, rounds: int = 64, files: int | None = None) -> DataFrame:
    """``node, component`` of every node that has an edge to another one.

    ``edges`` has two long columns ``u`` and ``v``, in either order; loops and nulls are
    ignored. The component is its smallest node. Work per round is two groupings and two
    joins over the edges, whose number never grows; a hot node is aggregated before the
    shuffle and its join can be split; few nodes are broadcast to the join. Every round is
    written to the shared folder, and the loop ends when every node has one edge, to a node
    that has none to a smaller one. The distinct edges are written to at most ``files`` files.
    """
    now = staged(
        edges.filter("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
        files,
    )
    for _ in range(rounds):
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        n, unsettled = nodes.agg(F.count("*"), F.count_if(F.expr("up > 1 or up = 1 and down = 1"))).first()
        if not unsettled:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        few = n <= BROADCAST_NODES
        now = staged(small_star(large_star(now, few), few), "edges", files_for(n, FILE_NODES))
    raise RuntimeError(f"no fixed point within {rounds} rounds")
