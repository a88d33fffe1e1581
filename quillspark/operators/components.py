"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.session import HOT_ROWS, cut, hot_keys, lookup

MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``vertex, component`` for each vertex of ``edges`` (columns a, b); the component is its smallest vertex.

    Each round every vertex points its larger neighbours, then its smaller ones, to the smallest vertex it knows; the edges
    become stars in a number of rounds that grows with the logarithm of the size. Minima are combined map-side, and
    vertices with very many edges are looked up from a bounded broadcast. Lineage is cut by reliable checkpoints.
    Edges with a null end are ignored; loops give a vertex of its own.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL")
    vertices = cut(pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct())
    now = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    for _ in range(MOST_ROUNDS):
        now = cut(_small_star(_large_star(now)))
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    return vertices.join(now.select(F.col("a").alias("vertex"), "b"), "vertex", "left").select("vertex", F.coalesce("b", "vertex").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).collect()[0]
    return r["n"], r["h"]


def _with_least(edges: DataFrame, own: bool) -> DataFrame:
    """Each edge (v, u) with the least of v and its neighbours."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")) if own else edges.groupBy("a").agg(F.min("b").alias("m"))
    hot = cut(hot_keys(edges, "a")) if edges.count() >= HOT_ROWS else False
    return lookup(edges, least, "a", "inner", hot)


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each vertex are linked to the least vertex of its neighbourhood."""
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return _with_least(both, True).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each vertex, and the vertex, are linked to the least of them."""
    down = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    moved = _with_least(down, False).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return moved.select("e.a", "e.b").where("a <> b").distinct()
