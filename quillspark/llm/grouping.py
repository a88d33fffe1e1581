"""One group for all records that pairwise matches link directly or indirectly.

Groups are found by low-diameter decomposition. On each level every vertex draws a head start from an
exponential distribution (rate ``beta``); clusters grow from the vertices with the largest remaining head
start, one hop a round, and stop where another cluster came first. Only about ``beta`` of the edges run
between clusters. Clusters are then contracted to super-vertices, the edges between them are the input of
the next level, and the assignments of all levels are composed. Growth goes on until no vertex hears of a better claim;
a label never leaves its component, so the result is exact.

Records aren't linked pair by pair but to the value they share, so a value shared by n records costs n
edges, and records with the same values are one vertex from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.session import HOT_ROWS, cut, hash_uniform, hot_keys, lookup

BETA = 0.1
#: Hops of growth between two checkpoints.
HOPS = 4
MOST_LEVELS = 60


def components(edges: DataFrame, beta: float = BETA, hops: int = HOPS, seed: int = 7) -> DataFrame:
    """``vertex, component`` for every vertex of ``edges`` (columns ``a``, ``b`` of one type that can be ordered).

    Self-loops, repeated edges and either direction are allowed; edges with a null end are ignored. The
    component's number is the vertex number of one of its members. No edges give no rows.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL")
    vertices = both.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    live = cut(_two_way(both))
    steps: list[tuple[int, DataFrame]] = []
    for level in range(MOST_LEVELS):
        if not (n := live.count()):
            break
        # The edges run both ways, so the hot vertices are the same at either end.
        hot = cut(hot_keys(live, "a")) if n >= HOT_ROWS else None
        hot = None if hot is None or hot.isEmpty() else hot
        grown = cut(_grow(live, hot, beta, hops, seed + level))
        steps.append((n, grown))
        live = cut(_contract(live, grown, hot))
    else:
        raise RuntimeError(f"edges remain after {MOST_LEVELS} levels")
    # Composed from the last level, the smallest, to the first. Everything in a giant component has one key by then.
    placed: DataFrame | None = None
    for n, grown in reversed(steps):
        if placed is not None:
            moved = placed.select(F.col("vertex").alias("cluster"), F.col("component").alias("_to"))
            grown = lookup(grown, moved, "cluster", "left", None if n >= HOT_ROWS else False).select("vertex", F.coalesce("_to", "cluster").alias("cluster"))
        placed = cut(grown.select("vertex", F.col("cluster").alias("component")))
    if placed is None:
        return vertices.withColumn("component", F.col("vertex"))
    return vertices.join(placed, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))


def _two_way(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct()


def _named(hot: DataFrame | None, name: str) -> DataFrame | bool:
    return False if hot is None else hot.select(F.col("a").alias(name))


def _grow(edges: DataFrame, hot: DataFrame | None, beta: float, hops: int, seed: int) -> DataFrame:
    """``vertex, cluster`` after growth from exponentially shifted starts, until no vertex changes its cluster."""
    starts = edges.select(F.col("a").alias("vertex")).distinct()
    state = starts.select("vertex", (-F.log(hash_uniform("vertex", seed=seed)) / beta).alias("left"), F.col("vertex").alias("cluster"))
    hop = edges.select(F.col("a").alias("vertex"), "b", F.lit(1.0).alias("cost")).unionByName(starts.select("vertex", F.col("vertex").alias("b"), F.lit(0.0).alias("cost")))

    def step(now: DataFrame) -> DataFrame:
        # The best claim each vertex hears of: its own, or a neighbour's with one hop less of head start.
        heard = lookup(hop, now, "vertex", "inner", _named(hot, "vertex"))
        best = heard.groupBy("b").agg(F.max(F.struct((F.col("left") - F.col("cost")).alias("left"), "cluster")).alias("claim"), F.max(F.when(F.col("cost") == 0, F.col("cluster"))).alias("was"))
        return best.select(F.col("b").alias("vertex"), "claim.left", "claim.cluster", (F.col("claim.cluster") != F.col("was")).alias("moved"))

    # A claim loses one a hop and the largest start is some ln(n) / beta, so a chain of that length is the most that can follow.
    while True:
        for _ in range(hops):
            state = step(state.select("vertex", "left", "cluster"))
            if hot is not None:
                state = cut(state)
        state = cut(state)
        if state.where("moved").isEmpty():  # the last hop moved nothing, so no further one does
            return state.select("vertex", "cluster")


def _contract(edges: DataFrame, grown: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The edges between clusters, as edges between super-vertices."""
    one = lookup(edges, grown.select(F.col("vertex").alias("a"), F.col("cluster").alias("ca")), "a", "inner", _named(hot, "a")).select("ca", "b")
    two = lookup(one, grown.select(F.col("vertex").alias("b"), F.col("cluster").alias("cb")), "b", "inner", _named(hot, "b"))
    return two.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def linked_groups(rows: DataFrame, order: str, keys: list[str], **options: int) -> DataFrame:
    """Each row of ``rows`` with its group: ``order``, ``group_<order>`` (the group's smallest ``order``) and ``group_rows``.

    Rows are linked by an equal non-null value of the same column of ``keys`` (already normalised). A row
    with no key, or whose keys nobody shares, is a group of its own. Null ``order`` values are allowed and
    rank last; repeated rows each come out; other columns are ignored. An empty table gives an empty result.

    Rows with the same keys are one vertex, so heaps of copies are combined map-side before anything is linked.
    """
    # 128 bits of hash, so that strangers don't meet at billions of values.
    wide = lambda *c: F.struct(F.xxhash64(F.lit(1), *c).alias("h"), F.xxhash64(F.lit(2), *c).alias("g"))
    typed = [F.when(F.col(k).isNotNull(), wide(F.lit(k), F.col(k).cast("string"))) for k in keys]
    every = rows.select(F.col(order).alias("_ord"), F.array_compact(F.array(*typed)).alias("_keys")).withColumn("_vertex", wide(F.lit("rows"), F.array_sort("_keys")))
    every = cut(every)
    linked = every.where(F.size("_keys") > 0)
    # Vertices and shared values are numbered once, odd and even; the tables are written before the numbers are used.
    numbered = F.monotonically_increasing_id() * 2
    vertices = linked.groupBy("_vertex").agg(F.min("_ord").alias("_least"), F.count(F.lit(1)).alias("_rows"), F.first("_keys").alias("_keys"))
    vertices = cut(vertices.withColumn("_id", numbered))
    ends = vertices.select("_id", F.explode("_keys").alias("_key"))
    shared = cut(ends.groupBy("_key").agg(F.count(F.lit(1)).alias("_ends")).where("_ends > 1").select("_key", (numbered + 1).alias("_value")))
    edges = lookup(ends, shared, "_key", "inner").select(F.col("_id").alias("a"), F.col("_value").alias("b"))
    found = components(edges, **options).select(F.col("vertex").alias("_id"), "component")
    placed = cut(vertices.select("_id", "_vertex", "_least", "_rows").join(found, "_id", "left").withColumn("component", F.coalesce("component", "_id")))
    totals = placed.groupBy("component").agg(F.min("_least").alias(f"group_{order}"), F.sum("_rows").alias("group_rows"))
    named = cut(lookup(placed.select("_vertex", "component"), totals, "component", "inner").drop("component"))
    return (
        lookup(linked.select("_ord", "_vertex"), named, "_vertex", "inner").select(F.col("_ord").alias(order), f"group_{order}", "group_rows")
        .unionByName(every.where(F.size("_keys") == 0).select(F.col("_ord").alias(order), F.col("_ord").alias(f"group_{order}"), F.lit(1).cast("bigint").alias("group_rows")))
    )
