"""References, topics, compression and manifests of documentation, and type hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_REF = r"([A-Za-z0-9_\-./]+\.(?:py|js|ts|tsx|jsx|go|rs|java|md|json|yaml|yml|toml))"


def file_refs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ref): file names in a text outside code fences, each once."""
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"```[\s\S]*?(```|$)", " ")
    return docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(FILE_REF), 1))).alias("ref"))


def check_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(id, ref, status, target): found as it stands, else as the end of a path (the shortest one), else missing.

    Ends of paths meet through the base name, so no text is held against every file.
    """
    clean = F.regexp_replace("ref", r"^(\./|/)+", "")
    base = lambda c: F.substring_index(c, "/", -1)
    rows = refs.select("id", "ref", clean.alias("clean"), base(clean).alias("base"))
    paths = files.select(F.col("path").alias("target"), base(F.col("path")).alias("base"))
    hit = rows.join(paths, "base").where((F.col("target") == F.col("clean")) | F.col("target").endswith(F.concat(F.lit("/"), F.col("clean"))))
    best = hit.groupBy("id", "ref").agg(F.min_by("target", F.struct(F.col("target") != F.col("clean"), F.length("target"), "target")).alias("target"))
    out = rows.select("id", "ref", "clean").join(best, ["id", "ref"], "left")
    status = F.when(F.col("target").isNull(), "missing").when(F.col("target") == F.col("clean"), "valid").otherwise("suffix")
    return out.select("id", "ref", status.alias("status"), "target")


def ref_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("id").agg(F.count("*").alias("refs"), F.count_if(F.col("status") == "missing").alias("missing"))


def page_topics(docs: DataFrame, id_col: str, text_col: str, heads: int = 5, bold: int = 3, most: int = 8) -> DataFrame:
    """(id, topics): the first headings and then the first bold spans, each once."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    head = F.slice(F.regexp_extract_all(t, F.lit(r"(?m)^#{1,6} +(.+?) *$"), 1), 1, heads)
    strong = F.slice(F.regexp_extract_all(t, F.lit(r"\*\*([^*\n]+)\*\*"), 1), 1, bold)
    return docs.select(F.col(id_col).alias("id"), F.slice(F.array_distinct(F.concat(head, strong)), 1, most).alias("topics"))


#: Long phrases and their short forms.
PHRASES = (("in order to", "to"), ("due to the fact that", "because"), ("at this point in time", "now"), ("in the event that", "if"), ("is able to", "can"), ("a large number of", "many"), ("it is important to note that ", ""), ("please note that ", ""), ("as well as", "and"), ("make sure to", "ensure you"))


def compress(text: Column) -> Column:
    """Shorter prose outside code fences: phrases, runs of blanks and blank lines, rulers."""

    def shorter(x: Column) -> Column:
        for long, short in PHRASES:
            x = F.regexp_replace(x, f"(?i){long}", short)
        x = F.regexp_replace(x, r"(?m)[ \t]+$", "")
        x = F.regexp_replace(x, r"(?m)^(-{3,}|\*{3,}|_{3,})$", "")
        return F.regexp_replace(F.regexp_replace(x, r"(?<=\S)[ \t]{2,}", " "), r"\n{3,}", "\n\n")

    # Odd parts lie between fences.
    parts = F.split(text, "```")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 0, shorter(x)).otherwise(x)), "```")


def compression(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, original_tokens, compressed_tokens, ratio) by the plain token rule."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    quarter = lambda c: F.floor(F.length(c) / 4).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), quarter(t).alias("original_tokens"), quarter(compress(t)).alias("compressed_tokens"))
    return rows.withColumn("ratio", F.coalesce(F.round(F.try_divide(F.col("compressed_tokens").cast("double"), F.col("original_tokens")), 4), F.lit(1.0)))


def type_hierarchy(types: DataFrame) -> DataFrame:
    """(type, parent, known) of (name, signature): parents after ``extends``, ``implements``, ``:`` or in brackets of a Python class."""
    lists = F.concat_ws(",", *(F.regexp_extract("signature", p, 1) for p in (r"extends\s+([\w.,\s<>]+?)(?:\s+implements|\s*\{|$)", r"implements\s+([\w.,\s<>]+?)(?:\s*\{|$)", r"^class\s+\w+\s*\(([^)]*)\)")))
    parent = F.regexp_replace(F.trim("p"), r"<.*$|^.*\.", "")
    rows = types.select("name", F.explode(F.split(lists, ",")).alias("p")).select(F.col("name").alias("type"), parent.alias("parent")).where("parent <> '' and parent <> 'object'").distinct()
    known = types.select(F.col("name").alias("parent")).distinct().withColumn("known", F.lit(True))
    return rows.join(known, "parent", "left").select("type", "parent", F.coalesce("known", F.lit(False)).alias("known"))


def content_hashes(chapters: DataFrame, files: DataFrame) -> DataFrame:
    """(chapter, content_hash): SHA-256 over the sorted (path, hash) of a chapter's sources."""
    h = files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("h"))
    rows = chapters.join(h, "path").groupBy("chapter").agg(F.sort_array(F.collect_list(F.struct("path", "h"))).alias("x"))
    return rows.select("chapter", F.sha2(F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["path"], r["h"])), "\n"), 256).alias("content_hash"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chapter, stale) of two (chapter, content_hash) tables; a chapter without an old hash is stale."""
    rows = new.join(old.select("chapter", F.col("content_hash").alias("old")), "chapter", "left")
    return rows.select("chapter", (~F.col("content_hash").eqNullSafe(F.col("old"))).alias("stale"))


def first_passing(scores: DataFrame, threshold: float = 0.65, most: int = 3) -> DataFrame:
    """(id, iterations): rounds until the score reaches the threshold, at most ``most``; ``scores`` is (id, iteration, overall)."""
    ok = F.min(F.when(F.col("overall") >= threshold, F.col("iteration")))
    return scores.where(F.col("iteration") <= most).groupBy("id").agg(F.coalesce(ok, F.max("iteration")).alias("iterations"))


def search_repositories(found: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` of (query_id, repo, id, score) over all repositories; ties go to the smallest repo and id."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "repo", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
