"""Commit history as text, as ``git log`` and ``git diff`` print it, turned into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``git log --name-only --format=%x1e%H%x1f%an%x1f%at%x1f%s%x1f%b%x1f``: a record per commit, fields told apart by control characters.
RECORD, FIELD = "\x1e", "\x1f"


def parse_log(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """(sha, author, ts, subject, body, paths): a row per commit of the logs; files with one name count once."""
    record = logs.select(F.explode(F.split(text_col, RECORD)).alias("r")).where(F.contains("r", F.lit(FIELD)))
    f = F.split("r", FIELD)
    paths = F.array_distinct(F.filter(F.split(F.get(f, F.lit(5)), "\n"), lambda x: x != ""))
    return record.select(F.trim(F.get(f, F.lit(0))).alias("sha"), F.get(f, F.lit(1)).alias("author"), F.get(f, F.lit(2)).cast("long").alias("ts"), F.get(f, F.lit(3)).alias("subject"), F.regexp_replace(F.get(f, F.lit(4)), r"^\s+|\s+$", "").alias("body"), paths.alias("paths"))


def commit_paths(log: DataFrame) -> DataFrame:
    """(sha, author, path) of commits, for co-change and ownership."""
    return log.select("sha", "author", F.explode("paths").alias("path"))


def parse_name_status(diffs: DataFrame, text_col: str = "text") -> DataFrame:
    """(path, status, old_path) of ``git diff --name-status``: added, modified, deleted, renamed, copied or other."""
    row = diffs.select(F.explode(F.split(text_col, "\n")).alias("l")).where(F.contains("l", F.lit("\t"))).select(F.split("l", "\t").alias("f"))
    kind = F.substring(F.get("f", F.lit(0)), 1, 1)
    moved = F.size("f") > 2
    names = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied"}
    status = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), kind), F.lit("other"))
    return row.select(F.when(moved, F.get("f", F.lit(2))).otherwise(F.get("f", F.lit(1))).alias("path"), status.alias("status"), F.when(moved, F.get("f", F.lit(1))).alias("old_path"))


def parse_blame(blames: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, author, lines) of ``git blame --line-porcelain``."""
    author = F.explode(F.regexp_extract_all(text_col, F.lit("(?m)^author (.*)$"), 1)).alias("author")
    return blames.select(F.col(path_col).alias("path"), author).groupBy("path", "author").agg(F.count("*").alias("lines"))
