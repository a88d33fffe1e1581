"""Quota buckets, gates and circuit breakers over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillspark.functions.text import period_start


def bucketed(events: DataFrame, ts: str, seconds: int | None) -> DataFrame:
    """Adds ``bucket``: the start of the UTC day or of the aligned period of ``seconds``."""
    return events.withColumn("bucket", period_start(F.col(ts), seconds))


def usage(events: DataFrame, source: str, ts: str, cost: str, seconds: int | None) -> DataFrame:
    """``source, bucket, used, n_events``: what each source used up in each bucket; null costs count as nothing."""
    return bucketed(events, ts, seconds).groupBy(F.col(source).alias("source"), "bucket").agg(F.sum(F.coalesce(F.col(cost).cast("double"), F.lit(0.0))).alias("used"), F.count(F.lit(1)).alias("n_events"))


def gate(events: DataFrame, source: str, ts: str, order: str, limit: int, seconds: int | None) -> DataFrame:
    """The events let through: the first ``limit`` of each source and bucket in the order of time, then ``order``.

    Spark keeps at most ``limit`` rows of a group before the shuffle (window group limit).
    """
    w = Window.partitionBy(source, "bucket").orderBy(ts, order)
    return bucketed(events, ts, seconds).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def breaker(events: DataFrame, source: str, ts: str, order: str, trips: str, seconds: int | None) -> DataFrame:
    """Adds ``denied``: whether an earlier event of the same source and bucket tripped the breaker (``trips`` is true).

    The tripping event itself is let through. The first trip of each bucket is one aggregate; no window sorts a bucket.
    """
    rows = bucketed(events, ts, seconds)
    first = rows.where(F.col(trips)).groupBy(F.col(source).alias("_s"), F.col("bucket").alias("_b")).agg(F.min(F.struct(F.col(ts).alias("t"), F.col(order).alias("o"))).alias("_first"))
    joined = rows.join(first, (F.col(source) == F.col("_s")) & (F.col("bucket") == F.col("_b")), "left")
    return joined.withColumn("denied", F.coalesce(F.struct(F.col(ts).alias("t"), F.col(order).alias("o")) > F.col("_first"), F.lit(False))).drop("_s", "_b", "_first")
