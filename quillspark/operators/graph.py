"""Graph operators on edge tables: neighbours, levels, paths, ego subgraphs, budgeted expansion.

Every round joins a frontier with the edges and removes what was seen; rounds are bounded by a fixed depth and
lineage is cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillspark.session import cut

MOST_DEPTH = 12


def upsert_edges(edges: DataFrame, order: str) -> DataFrame:
    """``source, target, relation``: one edge for each ordered pair, the last write wins."""
    return edges.groupBy("source", "target").agg(F.max_by("relation", F.col(order)).alias("relation"))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, neighbour`` along outgoing edges for each of ``nodes`` (one column node)."""
    return edges.join(nodes.select(F.col("node").alias("source")), "source").select(F.col("source").alias("node"), F.col("target").alias("neighbour")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))


def bfs_levels(edges: DataFrame, start: DataFrame, depth: int, directed: bool = True) -> DataFrame:
    """``node, level`` of all nodes within ``depth`` hops of ``start`` (one column node; level 0)."""
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be 0..{MOST_DEPTH}")
    hops = edges.select("source", "target") if directed else _both(edges)
    hops = hops.where("source IS NOT NULL AND target IS NOT NULL")
    seen = cut(start.where("node IS NOT NULL").distinct().withColumn("level", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        met = hops.join(frontier.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        frontier = cut(met.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def ego_subgraph(edges: DataFrame, centre: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``radius`` undirected hops of ``centre`` and all edges between them."""
    nodes = bfs_levels(edges, centre, radius, directed=False)
    inside = nodes.select("node")
    kept = edges.join(inside.withColumnRenamed("node", "source"), "source", "left_semi").join(inside.withColumnRenamed("node", "target"), "target", "left_semi")
    return nodes, kept.select("source", "target")


def shortest_paths(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``node, length, path``: a directed shortest path from ``start`` to each node within ``depth`` hops.

    Of equally short paths the one through the smallest parent is given, level by level.
    """
    hops = edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct()
    seen = cut(start.where("node IS NOT NULL").distinct().select("node", F.lit(0).alias("length"), F.array("node").alias("path")))
    frontier = seen
    for level in range(1, depth + 1):
        met = hops.join(frontier.select(F.col("node").alias("source"), "path"), "source").groupBy(F.col("target").alias("node")).agg(F.min_by("path", "source").alias("path"))
        frontier = cut(met.join(seen, "node", "left_anti").select("node", F.lit(level).alias("length"), F.concat("path", F.array("node")).alias("path")))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def expand_budgeted(edges: DataFrame, start: DataFrame, depth: int, budget: int) -> DataFrame:
    """``node, level, place`` of at most ``budget`` nodes met from ``start``, in the order level, parent's place, relation, node.

    ``edges`` has source, target and relation. The budget is the feature: a bounded expansion for a reader. As no level
    holds more rows than the budget, ranking a level is a bounded sort.
    """
    seen = cut(start.where("node IS NOT NULL").distinct().select("node", F.lit(0).alias("level"), F.row_number().over(Window.orderBy("node")).alias("place")))
    frontier, left = seen, budget
    for level in range(1, depth + 1):
        if left <= 0:
            break
        met = edges.join(frontier.select(F.col("node").alias("source"), F.col("place").alias("_p")), "source").where("target IS NOT NULL").join(seen.select(F.col("node").alias("target")), "target", "left_anti")
        best = met.groupBy(F.col("target").alias("node")).agg(F.min(F.struct("_p", "relation")).alias("o")).orderBy("o", "node").limit(left)
        frontier = cut(best.select("node", F.lit(level).alias("level"), (F.row_number().over(Window.orderBy("o", "node")) + F.lit(budget - left)).alias("place")))
        n = frontier.count()
        if not n:
            break
        left -= n
        seen = cut(seen.unionByName(frontier))
    return seen
