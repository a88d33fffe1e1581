"""Metered quotas with cost, increments and pages, interfaces of sources and stores."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window, functions as F

from quillspark.session import cut


class Source(Protocol):
    """What gives records for a request: a table of payloads in, a table of records out."""

    name: str

    def supports(self, operation: str) -> bool: ...

    def records(self, payloads: DataFrame, text: str) -> DataFrame: ...


class Store(Protocol):
    """What holds tables by name and takes batches."""

    def table(self, name: str) -> DataFrame: ...

    def save(self, papers: DataFrame, order: str) -> None: ...


def metered(events: DataFrame, source: str, ts: str, order: str, cost: str, limit: float) -> DataFrame:
    """Adds ``used`` (cost in the day before the event) and ``allowed``: while less than ``limit`` is used. Null costs count as 1; denied events
    cost like allowed ones, as a meter that counts what was asked.

    The running sum is made in two steps, over the minutes of a day and within a minute, so a busy source is no one task's work.
    """
    own = F.coalesce(F.col(cost), F.lit(1.0))
    rows = events.withColumn("_minute", F.date_trunc("minute", ts)).withColumn("_own", own)
    w = Window.partitionBy(source, "_minute").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    minutes = rows.groupBy(source, "_minute").agg(F.sum("_own").alias("_sum"))
    v = Window.partitionBy(source, F.date_trunc("day", "_minute")).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    before = minutes.withColumn("_before", F.coalesce(F.sum("_sum").over(v), F.lit(0.0))).drop("_sum")
    used = F.col("_before") + F.coalesce(F.sum("_own").over(w), F.lit(0.0))
    return rows.join(before, [source, "_minute"]).withColumn("used", used).withColumn("allowed", F.col("used") < limit).drop("_minute", "_own", "_before")


def coauthor_delta(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Co-author pairs (a, b, papers, first_year, last_year) after those of new papers are added: counts add up, the window of years widens."""
    rows = stored.unionByName(fresh)
    return rows.groupBy("a", "b").agg(F.sum("papers").alias("papers"), F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"))


def two_passes(by_id: DataFrame, by_search: DataFrame, key: str) -> DataFrame:
    """Records found by their id, and of a search those whose key the first pass didn't find."""
    return by_id.unionByName(by_search.join(by_id.select(key).distinct(), key, "left_anti").select(*by_id.columns))


def pages(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Adds ``page``: all rows in pages of ``size`` in the order of a unique key, for readers that take page by page.

    Rows of a key range are numbered inside their partition and shifted by the sizes of the partitions before, so nothing is sorted in one task.
    """
    placed = cut(rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy(key)
    numbered = placed.withColumn("_n", F.row_number().over(w))
    sizes = numbered.groupBy("_p").agg(F.max("_n").alias("_size"), F.min(key).alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return numbered.join(F.broadcast(before), "_p").withColumn("page", F.floor((F.col("_before") + F.col("_n") - 1) / size).cast("bigint")).drop("_p", "_n", "_before")
