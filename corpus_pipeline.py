"""Corpus pipeline: language ID, exact dedup, near-dedup, decontamination and mixing, one after the other.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows the one before kept. A row is
known by its ``doc_id`` and its text, so rows of one ``doc_id`` with different texts are decided
by themselves. Null texts and texts without a letter leave with the first stage; where a stage
gets them, null counts as empty, nothing is similar to a text without words, and such a text is taken
0 times. Of rows equal in ``doc_id`` and text the two dedup stages keep one, the smallest in its other columns;
ties between different ``doc_id`` are settled as in the operators. Columns of any name pass through; only
the mix replaces input columns named as its own (``size``, ``source_size``, ``target``, ``taken``). Empty tables
stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, language_id, mixing, near_dedup
from tessera.llm.common import lower_az, settle, table

#: The stages hold models and samples; SQL can't express them.
ORACLE_SQL = None


def _bounded(spark: SparkSession) -> None:
    """From here on Python workers of this session get batches of at most 4 MB, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def _restored(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(f"p_{i}").alias(c) for i, c in enumerate(columns)))


def _kept(docs: DataFrame, decided: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` and ``key`` are those of a kept row of ``decided`` (i, k, kept), one for each such pair."""
    columns = docs.columns
    plain = docs.select(F.col("doc_id").alias("i"), key.alias("k"), *(F.col(c).alias(f"p_{i}") for i, c in enumerate(columns)))
    pairs = decided.groupBy("i", "k").agg(F.count("*").alias("n"), F.max("kept").alias("any"))
    # What leaves is the smaller part, so the texts need not be dealt out for it.
    pairs = settle(pairs.where("n > 1 or not any").select(F.col("i").alias("i2"), F.col("k").alias("k2"), "any"), "leaving")
    same = lambda x: plain["i"].eqNullSafe(x["i2"]) & (plain["k"] == x["k2"])
    rows = plain.join(pairs, same(pairs), "left_anti").drop("i", "k")
    again = pairs.where("any")
    if again.isEmpty():
        return _restored(rows, columns)
    found = plain.join(again, same(again), "left_semi")
    least = found.groupBy("i", "k").agg(F.min(F.struct(*(f"p_{i}" for i in range(len(columns))))).alias("x")).select("x.*")
    return _restored(rows.unionByName(least), columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the language model rejects."""
    _bounded(spark)
    model = language_id.fit(docs)
    found = language_id.identify(docs, model, payload=tuple(docs.columns))
    return _restored(found.where("not rejected"), docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest ``doc_id`` of equal texts."""
    decided = exact_dedup.exact_groups(docs).select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("k"), "kept")
    return _kept(docs, decided, F.sha2(lower_az(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    rows = near_dedup.near_rows(docs.select(F.col("doc_id").cast("long").alias("id"), "text"))
    return _kept(docs, rows.select(F.col("id").alias("i"), F.col("th").alias("k"), "kept"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a window of the benchmark."""
    _bounded(spark)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), payload=tuple(docs.columns))
    return _restored(found.where("not contaminated"), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each (repeats counted)."""
    extra = ["size", "source_size", "target", "taken"]
    mixed = mixing.mix_sources(docs, payload=tuple(docs.columns)).where("taken > 0")
    return mixed.select(*(F.col(f"p_{i}").alias(c) for i, c in enumerate(docs.columns) if c not in extra), *extra)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"stage-{name}")
    return docs
