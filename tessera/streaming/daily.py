"""Streaming counterparts: daily usage with watermark, and change detection over file snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_dir


def daily_usage(spark: SparkSession, sf_dir: str, watermark: str = "2 days") -> DataFrame:
    """Counts and sums per day of the events read as a stream; runs to the end of what is there.

    Each batch appends the days that it changed to a table in the shared folder; of a day
    the row of the last batch holds. The watermark lets go of days that are over.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}")
    days = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total_value"))
    days = days.select(F.to_date("window.start").alias("day"), "n", "total_value")
    path = f"{shared_dir(spark)}/tessera/daily-{uuid.uuid4().hex}"
    save = lambda batch, i: batch.withColumn("batch", F.lit(i).cast("long")).write.mode("append").parquet(f"{path}/rows")
    run = days.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return rows.groupBy("day").agg(F.max_by("n", "batch").alias("n"), F.max_by("total_value", "batch").alias("total_value"))


def change_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, event_type) between two listings (path, hash): what a poll of the folder sees."""
    both = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full_outer")
    kind = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return both.select("path", kind.alias("event_type")).where("event_type is not null")


def latest_status(events: DataFrame) -> DataFrame:
    """The last event of each generation (generation_id, event_type, created_at)."""
    return events.groupBy("generation_id").agg(F.max_by("event_type", "created_at").alias("status"), F.max("created_at").alias("updated_at"))
