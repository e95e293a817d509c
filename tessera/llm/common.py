"""Shared plumbing of the training-data operators.

Lineage is cut by tables written into the shared folder that the session names
in ``spark.checkpoint.dir``; nothing is ever kept on a single executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.shared import discard, settle, shared_dir  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Java/RE2 pattern of white-space separated words.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Pattern of words of digits, lower-case Latin letters and all non-ASCII code points.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only; the ASCII-only texts take the cheaper built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def with_running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds the sum of each column of ``sums`` over all rows before this one in ``order``, in two levels.

    Rows are dealt out by ranges of ``order``; only one row of sums per range meets the others.
    """
    names = [f"_o{i}" for i in range(len(order))]
    df = df.select("*", *(c.alias(n) for n, c in zip(names, order, strict=True)), *(c.alias(f"_s_{k}") for k, c in sums.items()))
    ranged = settle(df.repartitionByRange(*names).withColumn("_range", F.spark_partition_id()), "ranges")
    per = ranged.groupBy("_range").agg(*(F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums))
    before = lambda c, *part: F.coalesce(F.sum(c).over(Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per range, as many as there are shuffle partitions.
    per = per.select("_range", *(before(f"_t_{k}").alias(f"_b_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(per), "_range").select("*", *((F.col(f"_b_{k}") + F.coalesce(F.sum(f"_s_{k}").over(inside), F.lit(0))).alias(k) for k in sums))
    return out.drop("_range", *names, *(f"_{x}_{k}" for x in "sb" for k in sums))
