"""Usage analytics over event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(events: DataFrame, done: Column, failed: Column, running: Column, value: str = "value") -> DataFrame:
    """One row: totals, three filtered counts, mean of the done ones, sum, success rate."""
    return events.agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("completed"),
        F.count_if(failed).alias("failed"),
        F.count_if(running).alias("running"),
        F.round(F.avg(F.when(done, F.col(value))), 4).alias("avg_value"),
        F.round(F.coalesce(F.sum(value), F.lit(0.0)), 2).alias("total_value"),
        F.coalesce(F.round(F.try_divide(F.count_if(done).cast("double"), F.count("*")), 4), F.lit(0.0)).alias("success_rate"),
    )


def daily(events: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    return events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total_value"))


def breakdown(events: DataFrame, key: Column, value: str = "value") -> DataFrame:
    """Per key (null: ``unknown``): count, mean and sum."""
    return events.groupBy(F.coalesce(key, F.lit("unknown")).alias("key")).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("avg_value"), F.round(F.sum(value), 2).alias("total_value"))


def most_used(events: DataFrame, key: Column) -> DataFrame:
    """The most frequent key; ties go to the smallest."""
    return events.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(1)


def top_users(events: DataFrame, k: int = 20) -> DataFrame:
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).orderBy(F.desc("n"), "user_id").limit(k)


def history_page(events: DataFrame, match: Column, offset: int = 0, size: int = 20) -> DataFrame:
    """A page of matching rows, newest first, with the count of all matches."""
    found = events.where(match)
    page = found.orderBy(F.desc("ts"), F.desc("event_id")).offset(offset).limit(size)
    # The count is one row by construction.
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total_matches"))))


def rate_window(events: DataFrame, seconds: int = 3600, limit: int = 3) -> DataFrame:
    """Per event: how many the user had in the ``seconds`` up to it, and whether that exceeds ``limit``."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.select("event_id", "user_id", F.count("*").over(w).alias("in_window")).withColumn("limited", F.col("in_window") > limit)


def streaks(events: DataFrame, bad: Column, at_least: int = 5) -> DataFrame:
    """Runs of consecutive bad events per user that would open a circuit breaker."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select("user_id", "ts", "event_id", bad.alias("bad"))
    rows = rows.withColumn("run", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w))
    return rows.where("bad").groupBy("user_id", "run").agg(F.count("*").alias("length"), F.min("event_id").alias("first_event")).where(F.col("length") >= at_least).select("user_id", "length", "first_event")


#: (model substring, dollars per million input tokens, per million output tokens); the first match wins.
PRICES = (("purchase", 3.0, 15.0), ("click", 0.25, 1.25), ("", 1.0, 2.0))


def cost(rows: DataFrame, model: str, tokens_in: str, tokens_out: str, prices=PRICES) -> DataFrame:
    """Adds ``cost``: tokens times the price of the first entry whose name the model contains."""
    price_in, price_out = (F.coalesce(*(F.when(F.contains(F.col(model), F.lit(p[0])), F.lit(p[i])) for p in prices)) for i in (1, 2))
    return rows.withColumn("cost", F.round((F.col(tokens_in) * price_in + F.col(tokens_out) * price_out) / 1_000_000, 9))
