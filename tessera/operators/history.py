"""Commit-history analytics over ``(sha, author, path)`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import settle


def co_change_pairs(commit_files: DataFrame, min_commits: int = 3, threshold: float = 0.5, max_files: int = 20) -> DataFrame:
    """Pairs of files changed together: counts and Jaccard share.

    Commits with more than ``max_files`` files are dropped before anything is paired, so
    a commit gives at most 190 pairs and the self-join on ``sha`` stays linear in commits.
    The threshold is held against the unrounded share.
    """
    files = commit_files.select("sha", "path").distinct()
    small = files.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n") <= max_files).select("sha")
    files = files.join(small, "sha")
    totals = files.groupBy("path").agg(F.count("*").alias("n"))
    a, b = files.select("sha", F.col("path").alias("file_a")), files.select("sha", F.col("path").alias("file_b"))
    pairs = a.join(b, "sha").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("co_change_count")).where(F.col("co_change_count") >= min_commits)
    pairs = pairs.join(totals.select(F.col("path").alias("file_a"), F.col("n").alias("total_a")), "file_a").join(totals.select(F.col("path").alias("file_b"), F.col("n").alias("total_b")), "file_b")
    share = F.col("co_change_count").cast("double") / (F.col("total_a") + F.col("total_b") - F.col("co_change_count"))
    return pairs.where(share >= threshold).select("file_a", "file_b", "co_change_count", "total_a", "total_b", F.round(share, 3).alias("jaccard"))


def hidden_coupling(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Adds whether a pair is linked by an import in either direction, and the confidence that goes with it (0.8 hidden, 0.5 linked)."""
    pairs = settle(pairs, "pairs")
    both = links.select(F.least("source", "target").alias("file_a"), F.greatest("source", "target").alias("file_b"))
    # Only links between paired files matter; the others leave before they are made distinct.
    both = both.join(pairs.select("file_a", "file_b"), ["file_a", "file_b"], "left_semi").distinct().withColumn("linked", F.lit(True))
    found = pairs.join(both, ["file_a", "file_b"], "left")
    linked = F.coalesce("linked", F.lit(False))
    return found.select(*pairs.columns, linked.alias("has_import"), F.when(linked, 0.5).otherwise(0.8).alias("confidence"))


def _owners(counts: DataFrame, key: str) -> DataFrame:
    """Top contributor, share and bus factor per ``key`` of (key, author, n) rows."""
    by_n = Window.partitionBy(key).orderBy(F.desc("n"), "author")
    all_n = Window.partitionBy(key)
    ranked = counts.select("*", F.row_number().over(by_n).alias("rank"), F.sum("n").over(by_n.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(all_n).alias("total"))
    return ranked.groupBy(key).agg(
        F.max("total").alias("total_commits"),
        F.count("*").alias("contributors"),
        F.max(F.when(F.col("rank") == 1, F.col("author"))).alias("top_author"),
        F.round(F.max(F.when(F.col("rank") == 1, F.col("n") / F.col("total"))), 6).alias("top_share"),
        F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("rank"))).cast("long").alias("bus_factor"),
    )


def with_risk(owners: DataFrame) -> DataFrame:
    return owners.withColumn("risk", F.when(F.col("bus_factor") <= 1, "critical").when(F.col("bus_factor") == 2, "warning").otherwise("ok"))


def file_ownership(commit_files: DataFrame) -> DataFrame:
    """Per file: commits, contributors, top author (ties: smallest), share, bus factor and risk."""
    return with_risk(_owners(commit_files.groupBy("path", "author").agg(F.countDistinct("sha").alias("n")), "path"))


def directory_ownership(commit_files: DataFrame, directories: DataFrame, max_bus_factor: int | None = None) -> DataFrame:
    """The same per directory of ``directories`` (path, dir), over the files kept by ``max_bus_factor``."""
    counts = commit_files.groupBy("path", "author").agg(F.countDistinct("sha").alias("n"))
    if max_bus_factor is not None:
        kept = _owners(counts, "path").where(F.col("bus_factor") <= max_bus_factor).select("path")
        counts = counts.join(kept, "path", "left_semi")
    sums = counts.join(directories, "path").groupBy("dir", "author").agg(F.sum("n").alias("n"))
    files = counts.select("path").distinct().join(directories, "path").groupBy("dir").agg(F.count("*").alias("files"))
    return with_risk(_owners(sums, "dir")).join(files, "dir")


def ownership_risks(commit_files: DataFrame, min_commits: int = 3) -> DataFrame:
    """Files that hang on one author, with the number of authors in the whole history."""
    authors = commit_files.agg(F.countDistinct("author").alias("repo_authors"))
    risky = file_ownership(commit_files).where((F.col("bus_factor") <= 1) & (F.col("total_commits") >= min_commits))
    # One row by construction.
    return risky.crossJoin(F.broadcast(authors))


CHANGE_TYPES = ("feat", "fix", "docs", "style", "refactor", "perf", "test", "build", "ci", "chore")


def changelog(commits: DataFrame) -> DataFrame:
    """(sha, type, scope, title) by conventional prefix; what has none is ``other``."""
    m = r"^(\w+)(?:\(([^)]*)\))?!?:\s*(.+)$"
    kind = F.regexp_extract("subject", m, 1)
    known = kind.isin(*CHANGE_TYPES)
    return commits.select("sha", F.when(known, kind).otherwise("other").alias("type"), F.when(known, F.regexp_extract("subject", m, 2)).otherwise("").alias("scope"), F.when(known, F.regexp_extract("subject", m, 3)).otherwise(F.col("subject")).alias("title"))


COCHANGE_SQL = """
WITH cf AS (SELECT DISTINCT l_orderkey AS sha, l_partkey AS path FROM lineitem),
ok AS (SELECT sha FROM cf GROUP BY sha HAVING count(*) <= 20), f AS (SELECT cf.* FROM cf JOIN ok USING (sha)),
n AS (SELECT path, count(*) AS c FROM f GROUP BY path),
p AS (SELECT a.path AS file_a, b.path AS file_b, count(*) AS cc FROM f a JOIN f b ON a.sha = b.sha AND a.path < b.path GROUP BY 1, 2),
pairs AS (SELECT file_a, file_b, cc AS co_change_count, na.c AS total_a, nb.c AS total_b, round(CAST(cc AS DOUBLE) / (na.c + nb.c - cc), 3) AS jaccard
FROM p JOIN n na ON na.path = file_a JOIN n nb ON nb.path = file_b WHERE cc >= 3)
"""
_OWN = """
WITH cf AS (SELECT DISTINCT l_orderkey AS sha, l_suppkey AS author, l_partkey AS path FROM lineitem),
c0 AS (SELECT path, author, count(DISTINCT sha) AS n FROM cf GROUP BY 1, 2), {counts}
k AS (SELECT *, row_number() OVER w AS rnk, sum(n) OVER (PARTITION BY key ORDER BY n DESC, author ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY key) AS total FROM c WINDOW w AS (PARTITION BY key ORDER BY n DESC, author)),
o AS (SELECT key, CAST(max(total) AS BIGINT) AS total_commits, count(*) AS contributors, max(CASE WHEN rnk = 1 THEN author END) AS top_author, round(max(CASE WHEN rnk = 1 THEN n / total END), 6) AS top_share, min(CASE WHEN upto * 2 >= total THEN rnk END) AS bus_factor FROM k GROUP BY key),
r AS (SELECT *, CASE WHEN bus_factor <= 1 THEN 'critical' WHEN bus_factor = 2 THEN 'warning' ELSE 'ok' END AS risk FROM o)
"""
_COLS = "total_commits, contributors, top_author, top_share, bus_factor, risk"
FILE_SQL = _OWN.format(counts="c AS (SELECT path AS key, author, n FROM c0),") + f"SELECT key AS path, {_COLS} FROM r"
DIR_SQL = _OWN.format(counts="c AS (SELECT p_brand AS key, author, CAST(sum(n) AS BIGINT) AS n FROM c0 JOIN part ON p_partkey = path GROUP BY 1, 2),") + f"SELECT key AS dir, {_COLS}, files FROM r JOIN (SELECT p_brand AS key, count(DISTINCT path) AS files FROM c0 JOIN part ON p_partkey = path GROUP BY 1) USING (key)"
RISK_SQL = _OWN.format(counts="c AS (SELECT path AS key, author, n FROM c0),") + f"SELECT key AS path, {_COLS}, (SELECT count(DISTINCT author) FROM cf) AS repo_authors FROM r WHERE bus_factor <= 1 AND total_commits >= 3"
