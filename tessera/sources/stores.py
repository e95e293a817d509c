"""Results kept between runs as Parquet tables: one folder per store, replaced by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, partition: list[str]) -> None:
    """Replaces the partitions that ``df`` has rows of; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def cache_entries(requests: DataFrame, key: Column, order: str) -> DataFrame:
    """(key_hash, first, uses): equal requests share one entry, made by the first of them."""
    return requests.groupBy(F.sha2(F.coalesce(key, F.lit("")).cast("binary"), 256).alias("key_hash")).agg(F.min(order).alias("first"), F.count("*").alias("uses"))


def changed_keys(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of ``new`` whose value is not that of ``old``: what an incremental run makes again."""
    return new.join(old.select(F.col(key).alias("_k"), F.col(value).alias("_v")), (F.col(key) == F.col("_k")) & F.col(value).eqNullSafe(F.col("_v")), "left_anti").select(key)


def registry(entries: DataFrame) -> DataFrame:
    """(name, path, n_changes): the state of a registry after its entries (at, action, name, path): the last one of each name, unless it removes it."""
    last = entries.groupBy("name").agg(F.max_by("action", "at").alias("action"), F.max_by("path", "at").alias("path"), F.count("*").alias("n_changes"))
    return last.where("action <> 'remove'").select("name", "path", "n_changes")
