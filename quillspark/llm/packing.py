"""Filling fixed-capacity containers: sum-of-squares packing.

Items are texts measured in tokens. A text larger than the capacity is cut into full containers and one
rest; only rests and smaller texts are packed. Each goes where the squared counts of open containers per
residual gap become smallest: opening a container of gap C-s adds 2*N(C-s)+1, filling gap g adds
2*(N(g-s)-N(g))+2, where N counts open containers by gap.

Items are spread over blocks by a hash; a block is packed by one task, and blocks grow in number, not in
size, with the data. Items of containers that a block leaves open are packed once more, largest first, within the block.
The full pieces of texts larger than a container need no packing and never enter a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Items in a block, about; as each gives at most one piece to it, the work and memory of a task are bounded by it.
BLOCK_ITEMS = 20_000
#: Kinds of container; one row each in ``capacities``.
MOST_KINDS = 1_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item, and the gap each container is left with.

    ``sizes`` are 1..capacity, in the order of arrival. Ties go to the smallest gap. An item that fills a gap
    exactly removes a container from the counts and so is always worth most among equals.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap; index 0 stays 0: full ones don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where = np.empty(len(sizes), dtype=np.int64)
    gaps: list[int] = []
    for i, s in enumerate(sizes.tolist()):
        # Change of the sum if the item goes into a container of gap g, for g = s..capacity.
        delta = 2 * (counts[: capacity - s + 1] - counts[s:])
        delta += 2
        delta[0] = -2 * counts[s] + 1  # gap s becomes 0
        delta = np.where(counts[s:] > 0, delta, np.iinfo(np.int64).max)
        g = s + int(np.argmin(delta))
        opening = 2 * counts[capacity - s] + 1 if s < capacity else 0
        if stacks[g] and delta[g - s] <= opening:
            box = stacks[g].pop()
            counts[g] -= 1
        else:
            box, g = len(gaps), capacity
            gaps.append(capacity)
        rest = g - s
        gaps[box] = rest
        where[i] = box
        if rest:
            stacks[rest].append(box)
            counts[rest] += 1
    return where, np.array(gaps, dtype=np.int64)


def close_gaps(where: np.ndarray, gaps: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Packs the items of containers that are still open once more, largest first, and keeps the better result."""
    open_boxes = gaps > 0
    again = np.flatnonzero(open_boxes[where])
    if not len(again):
        return where
    order = again[np.argsort(-sizes[again], kind="stable")]
    second, _ = sum_of_squares(sizes[order], capacity)
    if second.max() + 1 >= open_boxes.sum():
        return where
    out = where.copy()
    out[order] = len(gaps) + second
    return out


def _pack_block(rows: pd.DataFrame) -> pd.DataFrame:
    capacity = int(rows["capacity"].iloc[0])
    rows = rows.sort_values(["_at", "_item"], kind="stable")
    sizes = rows["n_tokens"].to_numpy()
    box = np.full(len(rows), -1, dtype=np.int64)
    some = np.flatnonzero((sizes > 0) & (sizes < capacity))
    if len(some):
        where, gaps = sum_of_squares(sizes[some], capacity)
        box[some] = close_gaps(where, gaps, sizes[some], capacity)
        box = np.where(box >= 0, box, -1)
    empty = np.flatnonzero(sizes <= 0)
    box[empty] = 0  # an empty text takes no room in the block's first container
    return rows.assign(box=box)


def pack(items: DataFrame, capacities: DataFrame, item: str, size: str, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``container, bin_id, <item>, piece, token_start, n_tokens`` for every item and each row of ``capacities``.

    ``items`` has a unique ``item`` and its size in tokens; a null, zero or negative size is an empty item, which
    takes no room. ``capacities`` has ``container`` and ``capacity_tokens`` (one row a kind of container, at most ``MOST_KINDS``; rows
    with a null or non-positive capacity are left out). An item larger than the capacity comes out as several
    pieces, all but the last filling a container of their own; any other item is one whole piece. ``bin_id`` (a text) is unique
    within a container kind. Equal sizes are told apart by the hash of the item. Empty inputs give no rows.
    """
    sized = items.select(F.col(item).alias("_item"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("_size"))
    kinds = capacities.where("capacity_tokens > 0").select("container", F.col("capacity_tokens").cast("bigint").alias("capacity")).limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of container")
    each = F.array(*[F.struct(F.lit(r["container"]).alias("container"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in kinds])
    each = each if kinds else F.array().cast("array<struct<container:string,capacity:bigint>>")
    n_blocks = _blocks(items, block_items)
    placed = sized.withColumn("_at", F.xxhash64("_item")).withColumn("_block", F.pmod(F.shiftright("_at", 7), F.lit(n_blocks)))
    kinded = placed.withColumn("_kind", F.explode(each)).select("*", "_kind.container", "_kind.capacity").withColumn("_full", F.expr("_size DIV capacity"))
    rest = kinded.where("_size = 0 OR _size % capacity > 0").select(
        "container", "capacity", "_block", "_at", "_item", F.col("_full").cast("int").alias("piece"), (F.col("_full") * F.col("capacity")).alias("token_start"), (F.col("_size") % F.col("capacity")).alias("n_tokens")
    )
    kind = items.schema[item].dataType.simpleString()
    packed = rest.groupBy("container", "_block").applyInPandas(
        _pack_block, f"container string, capacity bigint, _block bigint, _at bigint, _item {kind}, piece int, token_start bigint, n_tokens bigint, box bigint"
    )
    whole = kinded.where("_full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_full").cast("int") - 1)))
    columns = lambda bin_id, size: ["container", "capacity", bin_id.alias("bin_id"), F.col("_item").alias(item), "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), F.col(size).alias("n_tokens")]
    return packed.select(*columns(F.concat_ws("-", "_block", "box"), "n_tokens")).unionByName(whole.select(*columns(F.concat_ws("-", F.lit("full"), "_item", "piece"), "capacity")))


def _blocks(items: DataFrame, block_items: int) -> int:
    return max(1, -(-items.count() // block_items))


def packing_report(packed: DataFrame) -> DataFrame:
    """For each kind of container: how many were used, the tokens in them, and the share of room left over."""
    bins = packed.groupBy("container", "capacity", "bin_id").agg(F.sum("n_tokens").alias("_tokens"), F.count(F.lit(1)).alias("_pieces"))
    return bins.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("_tokens").alias("n_tokens"), F.sum("_pieces").alias("n_pieces"),
        (1 - F.sum("_tokens") / (F.count(F.lit(1)) * F.col("capacity"))).alias("unused_share"),
    )
