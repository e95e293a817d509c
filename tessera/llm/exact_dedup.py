"""Exact dedup by deterministic block naming.

Each normalised text is cut into fixed-size byte blocks. A block's name is its place in the
order of all distinct blocks by (64-bit bucket, bytes), written as two integers: ``b``, the
bucket, a hash of the bytes, and ``r``, the rank of the bytes among the distinct contents of that bucket.
Adjacent names are then paired and the pairs named in the same way, level by level,
until each document has one name. A name never stands for two contents: buckets with
several contents are found by an exact distinct over the contents themselves, and these
are sorted for their ranks. Where a bucket holds one content, as nearly all do, its rank is 0
without any sorting.

Ranks other than 0 arise only in buckets with several contents, so one shuffle of
the distinct contents decides a level, and only rows of such buckets are ever
joined. Distinct and counts combine on the map side; a third of all rows with one
text is a third of the rows nowhere but in the last join, which AQE splits.

A text's blocks are one row, so a text and its blocks must fit a task. Nulls count as empty
texts. Empty texts are equal to each other. Of rows equal in
text and ``doc_id`` the first stays. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lower_az, settle

BLOCK_BYTES = 4096


def _bucket(key: Column, bits: int) -> Column:
    h = F.xxhash64(key)
    return h if bits >= 64 else F.shiftrightunsigned(h, 64 - bits)


def _ranks(contents: DataFrame, level: int) -> DataFrame | None:
    """``(b, key, r)`` of the contents in buckets with several contents, None if there are none."""
    buckets = contents.groupBy("b", "key").agg(F.lit(1).alias("_")).groupBy("b").agg(F.count("*").alias("n"))
    several = settle(buckets.where("n > 1").select("b"), f"names{level}")
    if several.isEmpty():
        return None
    found = contents.join(several, "b", "left_semi").groupBy("b", "key").agg(F.lit(1).alias("_"))
    # One bucket holds as many rows as distinct contents share a hash.
    return found.selectExpr("b", "key", "cast(row_number() over (partition by b order by key) - 1 as int) as r")


def _renamed(rows: DataFrame, keep: list[str], parts: Column, ranks: DataFrame) -> DataFrame:
    """``rows`` with the names of ``parts`` looked up in ``ranks``; contents without an entry have rank 0."""
    each = rows.select(*keep, F.posexplode(parts).alias("pos", "part")).select(*keep, "pos", "part.b", "part.key")
    got = each.join(ranks, ["b", "key"], "left").select(*keep, "pos", "b", F.coalesce("r", F.lit(0)).alias("r"))
    listed = F.sort_array(F.collect_list(F.struct("pos", "b", "r")))
    return got.groupBy(*keep).agg(F.transform(listed, lambda x: F.struct(x.b.alias("b"), x.r.alias("r"))).alias("names"))


def name_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bits: int = 64) -> DataFrame:
    """One row per document: ``row`` (its number), ``doc_id``, ``n_bytes``, ``text_sha256``, ``b``, ``r``.

    Two rows have equal texts if and only if they have equal ``(n_bytes, b, r)``.
    ``bucket_bits`` below 64 makes buckets collide, for tests.
    """
    keep = ["row", "doc_id", "n_bytes", "text_sha256"]
    norm = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), lower_az(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("t"))
    n_blocks = F.greatest(F.ceil(F.octet_length("t") / block_bytes), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.substring(F.col("t"), i * block_bytes + 1, F.lit(block_bytes)))
    parts = F.transform(cut, lambda k: F.struct(_bucket(k, bucket_bits).alias("b"), k.alias("key")))
    blocks = norm.select("row", "doc_id", F.octet_length("t").alias("n_bytes"), F.sha2("t", 256).alias("text_sha256"), parts.alias("parts"))
    ranks = _ranks(norm.select(F.explode(cut).alias("key")).select(_bucket(F.col("key"), bucket_bits).alias("b"), "key"), 0)
    if ranks is None:
        named = blocks.select(*keep, F.transform("parts", lambda p: F.struct(p.b.alias("b"), F.lit(0).alias("r"))).alias("names"))
    else:
        named = _renamed(blocks, keep, F.col("parts"), ranks)
    named = settle(named, "blocks")

    level, done = 0, []
    longest = named.agg(F.max(F.size("names"))).first()[0] or 1
    while longest > 1:
        level += 1
        pair = lambda i: F.struct(F.get("names", i * 2).alias("x"), F.get("names", i * 2 + 1).alias("y"))
        pairs = F.transform(F.sequence(F.lit(0), F.expr("(size(names) + 1) div 2 - 1").cast("int")), pair)
        parts = F.transform(pairs, lambda k: F.struct(_bucket(k, bucket_bits).alias("b"), k.alias("key")))
        done.append(named.where(F.size("names") <= 1))
        long = named.where(F.size("names") > 1)
        ranks = _ranks(long.select(F.explode(parts).alias("p")).select("p.b", "p.key"), level)
        if ranks is None:
            paired = long.select(*keep, F.transform(parts, lambda p: F.struct(p.b.alias("b"), F.lit(0).alias("r"))).alias("names"))
        else:
            paired = _renamed(long, keep, parts, ranks)
        # Each level is written: the filters on the size of ``names`` move below an unwritten level's projection, and
        # their conditions, and with them the driver's plans, grow fourfold with each such level.
        named = settle(paired, f"level{level}")
        longest = (longest + 1) // 2
    for rows in done:
        named = named.unionByName(rows)
    return named.select(*keep, F.element_at("names", 1).b.alias("b"), F.element_at("names", 1).r.alias("r"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep_id`` is the largest ``doc_id`` of the equal texts (nulls are smallest).
    """
    named = settle(name_texts(docs, id_col, text_col, **kw), "texts")
    key = ["n_bytes", "b", "r"]
    most = named.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    first = named.groupBy(*key, "doc_id").agg(F.min("row").alias("first_row")).withColumnRenamed("doc_id", "keep_id")
    # ``first_row`` tells equal rows of one doc_id apart.
    groups = most.alias("m").join(first.alias("f"), [F.col(f"m.{k}") == F.col(f"f.{k}") for k in key] + [F.col("m.keep_id").eqNullSafe(F.col("f.keep_id"))]).select(*(f"m.{k}" for k in key), "m.keep_id", "group_size", "first_row")
    return named.join(groups, key).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("first_row")).alias("kept"), "text_sha256")


ORACLE_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
