"""The knowledge graph of a store: nodes and edges of five relations, expansion with stubs, refresh, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.operators.graph import bfs_levels, ego_subgraph, expand_budgeted, shortest_paths, upsert_edges

# Relations, in the order in which they are expanded, and which kind of node has them.
RELATIONS = ("references", "citations", "authors", "papers", "coauthors")
OF_KIND = {"paper": ("references", "citations", "authors"), "author": ("papers", "coauthors")}
VERSION = 1
MOST_NODES, MOST_DEPTH = 50, 3


def relations(names: list[str] | None) -> tuple[str, ...]:
    """Relations asked for in their fixed order; unknown ones are refused, None means all."""
    if names is None:
        return RELATIONS
    if unknown := set(names) - set(RELATIONS):
        raise ValueError(f"unknown relations: {', '.join(sorted(unknown))}")
    return tuple(r for r in RELATIONS if r in names)


def relation_edges(citations: DataFrame, ships: DataFrame, coauthors: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """``source, target, relation`` of all relations: both directions of citations (citing, cited), of authorship (paper, author; names
    without an id are left out) and of co-authorship (a, b). The order of expansion is the relation's place, as a column ``place``."""
    known = ships.where(~F.col("author").startswith("~"))
    parts = {
        "references": citations.select(F.col("citing").alias("source"), F.col("cited").alias("target")), "citations": citations.select(F.col("cited").alias("source"), F.col("citing").alias("target")),
        "authors": known.select(F.col("paper").alias("source"), F.col("author").alias("target")), "papers": known.select(F.col("author").alias("source"), F.col("paper").alias("target")),
        "coauthors": coauthors.select(F.col("a").alias("source"), F.col("b").alias("target")).unionByName(coauthors.select(F.col("b").alias("source"), F.col("a").alias("target"))),
    }
    out = None
    for r in relations(wanted):
        part = parts[r].select("source", "target", F.lit(r).alias("relation"), F.lit(RELATIONS.index(r)).alias("place"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no relation asked for")
    return out


def expand(edges: DataFrame, records: DataFrame, start: DataFrame, depth: int = MOST_DEPTH, budget: int = MOST_NODES) -> DataFrame:
    """``node, level, place, title, loaded`` of at most ``budget`` nodes met from ``start``; nodes without a record (node, title) are stubs
    (loaded false). Relations are followed in their fixed order."""
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be 0..{MOST_DEPTH}")
    met = expand_budgeted(edges.select("source", "target", F.col("place").alias("relation")), start, depth, min(budget, MOST_NODES))
    return refreshed(met, records)


def refreshed(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """Nodes with the title of their record, where there is one: stubs that have been stored since are upgraded."""
    known = records.groupBy("node").agg(F.min(F.struct("title")).alias("r"))
    return nodes.drop("title", "loaded").join(known, "node", "left").withColumn("title", F.col("r.title")).withColumn("loaded", F.col("r").isNotNull()).drop("r")


def missing_neighbours(edges: DataFrame, nodes: DataFrame, records: DataFrame) -> DataFrame:
    """``node, relation, n_missing``: per node and relation the neighbours nobody has stored, which a fetch would have to get."""
    near = edges.join(nodes.select(F.col("node").alias("source")), "source").select("source", "relation", F.col("target").alias("node")).distinct()
    lost = near.join(records.select("node").distinct(), "node", "left_anti")
    return lost.groupBy(F.col("source").alias("node"), "relation").agg(F.count(F.lit(1)).alias("n_missing"))


class Graph:
    """Nodes (``node, kind, title``) and edges (``source, target, relation``), with the operations a session has on them."""

    def __init__(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes, self.edges = nodes, edges

    def add(self, nodes: DataFrame, edges: DataFrame, order: str) -> Graph:
        """The graph with more nodes (the last of a key counts) and edges (one an ordered pair, the last write wins)."""
        old = self.edges.withColumn(order, F.lit(None).cast(edges.schema[order].dataType))
        kept = self.nodes.join(nodes.select("node").distinct(), "node", "left_anti")
        return Graph(kept.unionByName(nodes.select(*self.nodes.columns)), upsert_edges(old.unionByName(edges.select(*old.columns)).withColumn("_o", F.struct(F.col(order).isNotNull(), F.col(order))), "_o"))

    def neighbours(self, node: str) -> DataFrame:
        out = self.edges.where(F.col("source") == node).select("relation", F.col("target").alias("node"))
        return out.join(self.nodes, "node", "left").orderBy("node")

    def subgraph(self, centre: DataFrame, radius: int) -> Graph:
        inside, kept = ego_subgraph(self.edges, centre, radius)
        return Graph(self.nodes.join(inside.select("node"), "node", "left_semi"), self.edges.join(kept.distinct(), ["source", "target"], "left_semi"))

    def levels(self, centre: DataFrame, depth: int) -> DataFrame:
        return bfs_levels(self.edges, centre, depth)

    def path(self, source: str, target: str, depth: int = 12) -> list[str]:
        """A shortest directed path, empty if there is none within ``depth`` hops; one row at most comes to the driver."""
        start = self.nodes.sparkSession.createDataFrame([(source,)], "node string")
        found = shortest_paths(self.edges, start, depth).where(F.col("node") == target).select("path").limit(1).collect()
        return list(found[0]["path"]) if found else []

    def counts(self) -> DataFrame:
        """``version, node_count, edge_count`` in one row."""
        n = self.nodes.agg(F.count(F.lit(1)).alias("node_count"), F.lit(1).alias("_one"))
        return n.join(self.edges.agg(F.count(F.lit(1)).alias("edge_count"), F.lit(1).alias("_one")), "_one").select(F.lit(VERSION).alias("version"), "node_count", "edge_count")

    def save(self, path: str) -> None:
        """Writes a snapshot: nodes, edges and counts in a folder of its own; readers find it once the counts, written last, are there."""
        self.nodes.write.mode("overwrite").json(f"{path}/nodes")
        self.edges.write.mode("overwrite").json(f"{path}/edges")
        self.counts().write.mode("overwrite").json(f"{path}/counts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        """Reads a snapshot after checking its version, counts, repeated keys, empty fields and edges without nodes."""
        nodes = spark.read.schema("node string, kind string, title string").json(f"{path}/nodes")
        edges = spark.read.schema("source string, target string, relation string").json(f"{path}/edges")
        told = spark.read.schema("version int, node_count bigint, edge_count bigint").json(f"{path}/counts").collect()
        if len(told) != 1 or told[0]["version"] != VERSION:
            raise ValueError(f"not a graph snapshot of version {VERSION}")
        wrong = problems(nodes, edges, told[0]["node_count"], told[0]["edge_count"]).where("n > 0").collect()  # one row a kind of problem
        if wrong:
            raise ValueError("graph snapshot: " + ", ".join(f"{r['n']} {r['problem']}" for r in wrong))
        return Graph(nodes, edges)


def problems(nodes: DataFrame, edges: DataFrame, node_count: int, edge_count: int) -> DataFrame:
    """``problem, n``: how often a snapshot breaks each rule."""
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    key = nodes.select("node").distinct()
    dangling = edges.select(F.explode(F.array("source", "target")).alias("node")).join(key, "node", "left_anti")
    off = lambda d, told, name: d.agg(F.abs(F.count(F.lit(1)) - F.lit(told)).alias("n")).select(F.lit(name).alias("problem"), "n")
    return (
        count(nodes.where(blank("node") | blank("kind")), "nodes without id or kind").unionByName(count(edges.where(blank("source") | blank("target") | blank("relation")), "edges without ends or relation"))
        .unionByName(count(nodes.groupBy("node").count().where("count > 1"), "repeated nodes")).unionByName(count(edges.groupBy("source", "target").count().where("count > 1"), "repeated edges"))
        .unionByName(count(dangling, "ends without a node")).unionByName(off(nodes, node_count, "nodes more or less than told")).unionByName(off(edges, edge_count, "edges more or less than told"))
    )


def snapshot_path(folder: str) -> str:
    return f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"


def stub_row(kind: Column, title: Column, node: Column) -> Column:
    """The name shown for a neighbour: its title, else its key."""
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(kind, F.lit(" "), node))
