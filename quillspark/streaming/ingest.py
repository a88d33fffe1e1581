"""Structured Streaming versions of the quota buckets and of the snapshot ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.text import work_key


def quota_stream(events: DataFrame, source: str, ts: str, cost: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Use per source and aligned bucket of a stream; a bucket is final once the watermark has passed it."""
    window = F.window(ts, f"{seconds} seconds")
    return events.withWatermark(ts, late).groupBy(F.col(source).alias("source"), window.alias("w")).agg(F.sum(F.coalesce(F.col(cost).cast("double"), F.lit(0.0))).alias("used"), F.count(F.lit(1)).alias("n_events")).select("source", F.col("w.start").alias("bucket"), "used", "n_events")


def citation_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Normalised citations of a growing folder of Parquet files, late and repeated ones too; ``ingest`` sorts out repeats."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.select(work_key(F.col("cited_id")).alias("cited"), work_key(F.col("citing_id")).alias("citing"), "recorded_at").where("cited IS NOT NULL AND citing IS NOT NULL")


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Stores each pair ``cited, citing`` of all files there are in ``target`` exactly once, however late it comes; a restart
    goes on where the last run ended.

    A micro-batch is one partition ``batch`` of the target: its pairs (with their earliest time in the batch) that no earlier
    batch has. A batch that is run again replaces its own partition. Times of pairs that are stored stay.
    """
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_spark_metadata")):
        raise ValueError(f"{target} was written by a file sink; start with a new target and checkpoint")
    fs.mkdirs(path)

    def store(rows: DataFrame, batch: int) -> None:
        pairs = rows.groupBy("cited", "citing").agg(F.min("recorded_at").alias("recorded_at"))
        there = rows.sparkSession.read.schema("cited string, citing string, batch bigint").parquet(target).where(F.col("batch") < batch)
        pairs.join(there.select("cited", "citing"), ["cited", "citing"], "left_anti").write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
